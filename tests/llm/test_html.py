"""Main texts of made pages whose article is known, odd markup, and the counted parts against brute force."""

import random
from collections import Counter, defaultdict

from worklens.llm import wrapper_induction as w

WORDS = [f"wort{i}" for i in range(300)]


def sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def semantic(rng, k):
    paragraphs = [f"Title {k} " + sentence(rng, 4)] + [sentence(rng, rng.randrange(5, 40)) for _ in range(rng.randrange(1, 9))]
    body = "".join(f"<p>{p}</p>" if rng.random() < 0.7 else f"<p><b>{p}<br>" for p in paragraphs[1:])
    menu = "".join(f'<li><a href="/{i}">{sentence(rng, 2)}</a>' for i in range(5))
    page = (
        f"<!DOCTYPE html><html><head><title>{paragraphs[0]}</title><style>p{{}}</style><script>var t='</p>';</script></head><body class='has-sidebar'><header><h1>Site</h1></header><nav><ul>{menu}</ul></nav>"
        f"<div class='cookie-notice'>{sentence(rng)}</div><article><header><h1>{paragraphs[0]}</h1><div class=byline>{sentence(rng, 2)}</div></header>{body}<p>Thank you for reading this site</p><div id=comments><h2>Comments</h2><article class=comment>{sentence(rng)}</article></div></article>"
        f"<aside>{sentence(rng)}</aside><form action=x>{sentence(rng)}<input><textarea><p>{sentence(rng)}</textarea></form><footer>&copy; {sentence(rng, 3)}</footer>"
    )
    return page, paragraphs


def plain(rng, k):
    """A template of divs without telling names: only alignment over the pages tells the parts apart."""
    paragraphs = [sentence(rng, rng.randrange(5, 40)) for _ in range(rng.randrange(2, 9))]
    menu = "".join(f'<a href="/{i}">{sentence(rng, 2)}</a> ' for i in range(4))
    body = "".join(f"<div>{p}</div>" for p in paragraphs)
    comments = "".join(f"<div>{sentence(rng)}</div>" for _ in range(rng.randrange(3)))
    page = f"<html><body><div class=a>My site of things<div>{menu}</div></div><div class=b><div>Welcome, please read our terms of use</div><div class=c>{body}</div><h3>3 Comments</h3>{comments}</div><div class=d>All rights reserved by us</div></body></html>"
    return page, paragraphs


def made(rng):
    rows, expected = [], {}
    for k in range(30):
        rows.append((k, f"https://News.example.com/{k}", *[semantic(rng, k)][0]))
    for k in range(30, 60):
        rows.append((k, f"http://blog.example.org?{k}", *[plain(rng, k)][0]))
    base = [sentence(rng, 20) for _ in range(12)]
    for k in range(60, 90):  # near copies on a host of their own: nothing is template
        own = base[:5] + [sentence(rng, 20)] + base[6:]
        rows.append((k, "http://copies.example.org/" + str(k), "<body>" + "".join(f"<p>{p}</p>" for p in own), own))
    for k in range(90, 95):  # exact copies count as one
        rows.append((k, "http://same.example.org/", "<body>" + "".join(f"<p>{p}</p>" for p in base), base))
    alone, own = semantic(rng, 95)  # on a host of one page nothing is constant
    rows.append((95, "http://one.example.org", alone, [*own, "Thank you for reading this site"]))
    rows.append((96, None, "<p>a &amp; b &lt;i&gt; &#233;&nbsp;&middot;  c\n\t d<p>3 < 5 and <em>6</em>7<!-- <p>no</p> --><div hidden>x</div><div style='display: none'>x</div>", ["a & b <i> é · c d", "3 < 5 and 67"]))
    rows.append((97, "no scheme", None, []))
    rows.append((98, "", "", []))
    rows.append((99, "http://deep.example.org/", "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after", ["deep", "after"]))
    rows.append((100, "http://cut.example.org/", "<p>x</p><script>if (a < b) {", ["x"]))
    rows.append((101, "http://cut.example.org/2", "<table><tr><td>a<td>b<tr><td><p>c</table><ul><li>d<li>e</ul><div class='unclosed", ["a", "b", "c", "d", "e"]))
    rows.append((102, "http://frame.example.org/", "<form class='page search'><main><h1>T</h1><article><p>body</p></article></main></form>", ["T", "body"]))
    body = "".join(f"<p>{p}</p>" for p in base[:4])
    rows.append((104, "http://a.example.com/", f"<div id=header><h1>Site</h1></div><div class='page has-sidebar'><h1>T</h1>{body}</div><div id=sidebar><p>side</div><ul class=comment-list><li>I think so<li>So do I</ul>", ["T", *base[:4]]))
    rows.append((105, "http://b.example.com/", f"<div role=navigation><p>go</div><form id=aspnet><div class=content><h1>T</h1>{body}<div class=adSlot><p>buy</div></div></form><section class=userComments><p>no</section><div class='alert toast'>cookies</div>", ["T", *base[:4]]))
    rows.append((106, "http://c.example.com/", f"<main><section>{body}</section><section id=comments><h2>2 Kommentare</h2><p>nein</section></main><div>outside</div>", base[:4]))
    rows.append((103, "http://long.example.org/", "<article>" + "".join(f"<p>{i} {'lang ' * 50}" for i in range(3000)), [f"{i} {'lang ' * 50}".strip() for i in range(3000)]))
    rows.append((103, *rows[-1][1:]))
    for r in rows:
        expected[r[0]] = "\n\n".join(r[3])
    return rows, expected


def test_main_texts(spark, tmp_path):
    rows, expected = made(random.Random(12))
    table = [(i, url, page, "x", 1) for i, url, page, _ in rows]
    spark.createDataFrame(table, "page_id long, url string, html string, host string, blocks int").write.parquet(f"{tmp_path}/pages.parquet")
    got = w.op12_html_extraction(spark, str(tmp_path)).collect()
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows)
    for r in got:
        assert r["text"] == expected[r["page_id"]], r["page_id"]
        assert r["n_chars"] == len(r["text"])


def test_wrappers_and_constants_by_brute_force(spark):
    """Random trees on three hosts: most frequent layout, alignment, menus and constants worked out page by page in one process."""
    rng = random.Random(8)
    kept = [sentence(rng, 6) for _ in range(6)]

    def tree(depth):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            tag = rng.choice(["div", "p", "section", "div class=x", "article"] if depth else ["div", "p"])
            inner = tree(depth - 1) if depth and tag != "p" and rng.random() < 0.6 else rng.choice([rng.choice(kept), sentence(rng, 5), f"<a href=x>{sentence(rng, 3)}</a>"])
            parts.append(f"<{tag}>{inner}</{tag.split()[0]}>")
        return "".join(parts)

    rows = [(k, f"http://h{k % 3}.example.com/", tree(2) if k % 4 else f"<div>{kept[k % 3]}</div><section><p>{sentence(rng)}</p><p>{sentence(rng)}</p></section><div>{kept[0]}</div>") for k in range(120)]
    of = defaultdict(list)
    for row in rows:
        of[row[1]].append(row)
    expected = {}
    for own in of.values():
        count = Counter(w.layout(w.tree(page)) for *_, page in own)
        wrapper = min(count, key=lambda t: (-count[t], t))
        cut = {k: [b for b in w.blocks(page, wrapper) if b[3]] for k, _, page in own}
        different = {tuple(b[1] for b in bs): {(b[0], b[1]) for b in bs} for bs in cut.values() if bs}
        seen = Counter(x for bs in different.values() for x in bs)
        constant = {x for x, n in seen.items() if n >= 5 and 2 * n >= len(different)}
        firm = {x for x in constant if 10 * seen[x] >= 9 * len(different)}
        links, chars = Counter(), Counter()
        for bs in cut.values():
            for slot, text, n, *_ in bs:
                links[slot] += n
                chars[slot] += len(text.replace(" ", ""))
        for k, bs in cut.items():
            bs = [b for b in bs if 2 * links[b[0]] < chars[b[0]]]
            vary = [b for b in bs if (b[0], b[1]) not in (firm if b[4] else constant)]
            few = 2 * sum(len(b[1]) for b in vary) < sum(len(b[1]) for b in bs)
            expected[k] = "\n\n".join(b[1] for b in (bs if few else vary))
    got = {r["page_id"]: r["text"] for r in w.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == expected and len(set(got.values())) > 60


def test_simple_tree_matching():
    """The alignment matches as many nodes as any order-keeping one, tried exhaustively on small trees."""
    rng = random.Random(2)

    def grown(depth):
        return [rng.choice("ab"), [grown(depth - 1) for _ in range(rng.randrange(3) if depth else 0)], 0]

    def best(x, y):
        if x[0] != y[0]:
            return 0

        def lists(a, b):
            if not a or not b:
                return 0
            return max(lists(a[1:], b), lists(a, b[1:]), best(a[0], b[0]) + lists(a[1:], b[1:]))

        return 1 + lists(x[1], y[1])

    def numbered(x, n):
        x[2] = n[0]
        n[0] += 1
        for kid in x[1]:
            numbered(kid, n)
        return x

    def as_group(x):
        kids = [as_group(k) for k in x[1]]
        return (x[0], x[0] + "(" + ",".join(k[1] for k in kids) + ")", kids, [])

    for _ in range(300):
        x, y = grown(3), numbered(grown(3), [0])
        assert w._weight(as_group(x), y, {}) == best(x, y)


def test_no_pages(spark):
    assert w.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
