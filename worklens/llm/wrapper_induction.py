"""Main text of web pages by wrapper induction: trees of same-host pages are aligned, what stays constant is template.

1. Layouts. Each page's tree of block elements is written as a string in which near children of equal layout are one.
   They are counted by (host, layout) over all pages; a host's wrapper is its most frequent layout (ties: the smallest).
2. Alignment. Each page is aligned with its host's wrapper by simple tree matching: roots must have the same key (tag, classes),
   children are aligned in order for the greatest number of matched nodes. Children left over join the nearest child of the same key, as further
   records of a list; others are slots of their own, named by their path. So each text block gets a slot of the wrapper.
3. Slots. Over all pages of a host: a text that stands in the same slot on half of the different pages or more (nine tenths where the page
   marks its main part or article, for lines of articles repeat too), five at least, is constant and belongs to the template; a slot of which half or more is link text is a menu; all other slots vary and are content.
   Exact copies of a page count as one. Where constants are over half of a page's content, the page is one of near copies: they stay.
4. Roles. Elements whose tag, role or class says menu, header, footer, sidebar, notice, advert, form, reader comments are
   template too, however much they vary, but not where they frame the article: where they hold main, an article with its h1, or an h1 and over
   half of the page's text. Headings of an article's own header stay. Where a page marks its main part or its article, only blocks in it are content.

Layouts, slots and constants are counted by Spark with partial sums over all pages; the wrapper and the constants of a host are bounded by
the size of a few of its pages, not by their number. Texts and slots are counted by 64-bit hashes.

Defined results: null and empty html give an empty text; a null url, or one without ``://``, has the empty host; a host of up to four different
pages has no constants, there roles decide; broken markup is read as browsers do in its main lines (unclosed p, li, td; stray end tags); repeated
rows keep a row each; an empty table gives an empty result; other columns are ignored. White space is Unicode's, no-break spaces too.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import materialise, table

# Fixed names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav"
    " ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Never part of the main text.
OUT = frozenset("head script style textarea title iframe xmp noembed noframes noscript template object svg canvas audio video map select option optgroup button datalist nav footer aside menu dialog form search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset(["td", "th"])
#: What an opening tag closes, and the elements beyond which it doesn't look.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "td": (CELLS, frozenset(["tr", "table"])),
    "th": (CELLS, frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form note".split())
# Words in class names and ids that say that an element is not the article.
NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead topbar footer sidebar aside widget widgets ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion"
    " banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments"
    " commentlist respond disqus reply replies login search searchbox pagination pager toolbar skip copyright teaser paywall hidden"
    " adbox adslot adsense adwrap disclaimer announcement announcements toast snackbar commentbox commentsection usercomments".split()
)
COMMENTS = re.compile(r"(?:\d+ )?(?:reader |leser|user )?(?:comments?|kommentare?|commentaires?|comentarios?)(?: \(?\d+\)?)?:?", re.I)

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?=[\s=/]|\Z)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}


P, NONE, ROOTS = frozenset(["p"]), frozenset(), frozenset(["html", "body"])
IN_BUTTON, IN_CELL = frozenset(["td", "th", "table", "button"]), frozenset(["td", "th", "table"])
TABLES = frozenset("table tr td th tbody thead tfoot body html".split())
ONE = {tag: frozenset([tag]) for tag in BLOCKS}
TELLING = re.compile("class|id|role|style|hidden", re.I)

#: Elements nested deeper than this are read as part of the one above, as browsers do from some depth on.
DEEPEST = 150
#: Records of a list may have up to so many alternating layouts.
NEAR = 4


class Node:
    """A block element: key for alignment, children (nodes, and texts as [text, characters in links, drop]), whether it's out of the article."""

    __slots__ = ("tag", "key", "kids", "out", "header", "above", "depth")

    def __init__(self, tag: str, key: str, out: bool, header: bool, above: Node | None):
        self.tag, self.key, self.out, self.header, self.above = tag, key, out, header, above
        self.kids: list = []
        self.depth: int = above.depth + 1 if above is not None else 0


def _described(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """(key, out of the article by role or class, a header, hidden) of an element."""
    named, out, hidden, header, is_main = [], tag in OUT, False, tag == "header", tag == "main"
    if attributes and TELLING.search(attributes):
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "role":
                out |= value.lower() in ROLES
                is_main |= value.lower() == "main"
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "").lower()
            elif name in ("hidden", "aria-hidden"):
                hidden |= name == "hidden" or value.lower() == "true"
            else:
                named += re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", value).lower())
    words = set(named)
    header |= "header" in words
    out |= tag not in ("html", "body", "article", "main") and not NAMES.isdisjoint(words)
    out |= tag == "article" and not words.isdisjoint(("comment", "reply", "ad", "advert", "related", "teaser"))
    return ".".join(["main" if is_main else tag, *dict.fromkeys(named)]), out, header, hidden


def tree(page: str) -> Node:
    """The block elements of a page, with the texts between their borders."""
    root = Node("#root", "#root", False, False, None)
    at, here, text, links, marks, place, n = root, 0, [], 0, [], 0, len(page)
    # marks: open inline elements as (tag, out); here: how many of them are out
    anchors = 0
    deeper: list[str] = []  # open elements below DEEPEST

    def flush():
        nonlocal text, links
        if text:
            words = " ".join("".join(text).split())
            if words:
                at.kids.append([words, links, False])
            text, links = [], 0

    def said(raw: str):
        nonlocal links
        if here == 0:
            raw = entities.unescape(raw) if "&" in raw else raw
            text.append(raw)
            if anchors:
                links += len("".join(raw.split()))

    def leave(to: Node):
        nonlocal at, marks, here, anchors
        flush()
        at = to.above
        marks, here, anchors = [], 0, 0

    def within(tags: frozenset, stops: frozenset) -> Node | None:
        node = at
        while node.above is not None and node.tag not in stops:
            if node.tag in tags:
                return node
            node = node.above
        return None

    while place < n:
        found = TOKEN.search(page, place)
        if found is None:
            said(page[place:])
            break
        if found.start() > place:
            said(page[place : found.start()])
        place = found.end()
        tag = found[2] or found[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), found[1] or found[4], found[3] or found[6] or ""
        if found[2] is None and place == n and not page.endswith(">"):
            break  # a tag that the end of the page cuts off
        if closing:
            if deeper and tag in BLOCKS:
                flush()
                if deeper[-1] == tag:
                    deeper.pop()
            elif tag in BLOCKS:
                open_one = at if at.tag == tag else within(ONE[tag], NONE if tag in TABLES else IN_CELL)
                if open_one is not None:
                    leave(open_one)
                elif tag == "p":
                    flush()
            else:
                for k in range(len(marks) - 1, -1, -1):
                    if marks[k][0] == tag:
                        here -= marks[k][1]
                        anchors -= tag == "a"
                        del marks[k]
                        break
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, place)
            close = page.find(">", end.end()) if end else -1
            place = close + 1 if close >= 0 else n
            continue
        if tag in BLOCKS and at.depth >= DEEPEST:
            flush()
            deeper += [tag] * (tag != "hr")
        elif tag in BLOCKS:
            if tag in CLOSES:
                tags, stops = CLOSES[tag]
                if (open_one := within(tags, stops)) is not None:
                    leave(open_one)
            elif (open_one := within(P, IN_BUTTON)) is not None:
                leave(open_one)
            if tag in ROOTS and within(ONE[tag], NONE) is not None:
                continue
            flush()
            if tag == "hr":
                continue
            key, out, header, hidden = _described(tag, attributes)
            node = Node(tag, key, out or hidden or here > 0, header, at)
            at.kids.append(node)
            at, marks, here, anchors = node, [], 0, 0
        elif tag == "br":
            said(" ")
        elif tag not in VOID and not attributes.endswith("/"):
            gone = tag in OUT
            if attributes and TELLING.search(attributes):
                _, out, _, hidden = _described(tag, attributes)
                gone = out or hidden
            marks.append((tag, gone))
            here += gone
            anchors += tag == "a"
    flush()
    return root


def _written(key: str, groups: list[tuple]) -> str:
    return f"{key}({','.join(g[1] for g in groups)})" if groups else key


def layout(node: Node) -> str:
    """The tree as a string; near children of equal layout are one."""
    return _written(node.key, _grouped(node))


def read_layout(text: str) -> list:
    """[key, children, number] of a layout string; numbers count nodes from the root on."""
    root = node = ["", [], 0]
    above, number = [], 0
    for key, mark in re.findall(r"([^(),]*)([(),]|\Z)", text):
        if key:
            number += 1
            node = [key, [], number]
            (above[-1] if above else root)[1].append(node)
        if mark == "(":
            above.append(node)
        elif mark == ")" and above:
            node = above.pop()
    return root[1][0] if root[1] else root


def key_of(kid) -> str:
    return kid.key if isinstance(kid, Node) else "#"


def _matched(a: list, b: list, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two lists of children: matched nodes, and which pairs."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    weigh = [[_weight(x, y, memo) for y in b] for x in a]
    for i in range(len(a)):
        row, above = best[i + 1], best[i]
        for j in range(len(b)):
            row[j + 1] = max(row[j], above[j + 1], above[j] + weigh[i][j])
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return best[-1][-1], pairs[::-1]


def _weight(x: tuple, y: list, memo: dict) -> int:
    """Matched nodes of two trees: none if the roots differ. x is (key, layout, children groups)."""
    if x[0] != y[0]:
        return 0
    at = (x[1], y[2])
    if at not in memo:
        memo[at] = 1 + (_matched(x[2], y[1], memo)[0] if x[2] and y[1] else 0)
    return memo[at]


def _grouped(node: Node) -> list[tuple]:
    """Children as (key, layout, their groups, the children themselves); those of equal layout at up to ``NEAR`` groups' distance are one group."""
    out: list[tuple] = []
    for kid in node.kids:
        inner = _grouped(kid) if isinstance(kid, Node) else []
        made = _written(kid.key, inner) if isinstance(kid, Node) else "#"
        same = next((g for g in out[-NEAR:] if g[1] == made), None)
        if same is None:
            out.append((key_of(kid), made, inner, [(kid, inner)]))
        else:
            same[3].append((kid, inner))
    return out


def aligned(root: Node, wrapper: list, memo: dict) -> dict[int, str]:
    """id of each node and text of a page -> its slot in the wrapper. ``memo`` keeps what was found for the wrapper before."""
    slots: dict[int, str] = {id(root): "1"}
    todo = [(_grouped(root), wrapper, "1")]
    while todo:
        groups, known, slot = todo.pop()
        kids = known[1] if known is not None else []
        pairs: dict[int, int] = {}
        if groups and kids:
            at = (",".join(g[1] for g in groups), -known[2])
            if at not in memo:
                memo[at] = dict(_matched(groups, kids, memo)[1])
            pairs = memo[at]
        last: dict[str, list] = {}
        for i, (key, _, _, members) in enumerate(groups):
            match = kids[pairs[i]] if i in pairs else last.get(key) or next((k for k in kids if k[0] == key), None)
            if match is not None:
                last[key] = match
            own = str(match[2]) if match is not None else f"{slot}/{key}"
            for kid, inner in members:
                slots[id(kid)] = own
                if inner:
                    todo.append((inner, match, own))
    return slots


def _holds(node: Node, memo: dict[int, tuple[bool, bool, int]]) -> tuple[bool, bool, int]:
    """(holds an h1, holds main or an article with an h1, characters of text) of a node's inside."""
    if id(node) not in memo:
        heading, frame, size = False, False, 0
        for kid in node.kids:
            if isinstance(kid, Node):
                h, f, n = _holds(kid, memo)
                own = kid.key.split(".", 1)[0]
                heading |= h or kid.tag == "h1"
                frame |= f or own == "main" or (own == "article" and h and not kid.out)
                size += n
            else:
                size += len(kid[0])
        memo[id(node)] = (heading, frame, size)
    return memo[id(node)]


def blocks(page: str, wrapper: str | None, known: dict | None = None) -> list[tuple[str, str, int, bool, bool]]:
    """(slot, text, characters in links, content by its role, the page marks its article) of all text blocks, in page order. ``known`` keeps wrappers read before."""
    root = tree(page)
    known = {} if known is None else known
    if wrapper not in known:
        if len(known) >= 100:
            known.clear()
        known[wrapper] = (read_layout(wrapper) if wrapper else ["#root", [], 1], {})
    if len(known[wrapper][1]) > 10_000:
        known[wrapper][1].clear()
    slots = aligned(root, *known[wrapper])
    memo: dict[int, tuple[bool, bool, int]] = {}
    total = _holds(root, memo)[2]
    found: list[tuple] = []  # (slot, text, links, kept by role, in main, number of the article around)
    articles = 0

    def walk(node: Node, out: bool, header: bool, main: bool, article: int):
        nonlocal articles
        comments = False
        for kid in node.kids:
            if isinstance(kid, list):
                heading = node.tag in HEADINGS
                found.append((slots[id(kid)], kid[0], kid[1], not out and not comments and (not header or (heading and (main or article > 0))), main, article))
                continue
            h1, frames, size = _holds(kid, memo)
            frames = frames or (h1 and 2 * size > total)
            own = kid.key.split(".")[0]
            now_main = main or own == "main"
            now_article = article
            gone = out or (kid.out and not frames)
            if own == "article" and not article and not gone:
                articles += 1
                now_article = articles
            comments |= kid.tag in HEADINGS and kid.tag != "h1" and any(isinstance(t, list) and COMMENTS.fullmatch(t[0]) for t in kid.kids)
            walk(kid, gone or comments, header or (kid.header and not frames), now_main, now_article)

    walk(root, False, False, False, 0)
    kept = [b for b in found if b[3]]
    mains = any(b[4] for b in kept)
    scope = (lambda b: b[4]) if mains else (lambda b: b[5] > 0) if any(b[5] for b in kept) else (lambda b: True)
    if mains and len({b[5] for b in kept if b[4] and b[5]}) == 1:
        inner = next(b[5] for b in kept if b[4] and b[5])
        title = {i for i, b in enumerate(found) if b[4] and not b[5]} & _titles(root, found)
        return [(b[0], b[1], b[2], b[3] and b[4] and (b[5] == inner or i in title), True) for i, b in enumerate(found)]
    marked = mains or any(b[5] for b in kept)
    return [(b[0], b[1], b[2], bool(b[3] and scope(b)), marked) for b in found]


def _titles(root: Node, found: list) -> set[int]:
    """Which of the texts, in page order, stand in an h1."""
    out: set[int] = set()
    number = 0

    def walk(node: Node):
        nonlocal number
        for kid in node.kids:
            if isinstance(kid, list):
                if node.tag == "h1":
                    out.add(number)
                number += 1
            else:
                walk(kid)

    walk(root)
    return out


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [layout(tree(page or "")) for page in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["host", "layout"])


def _key(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_SEEN = "host string, page long, texts array<long>, slots array<struct<slot:long,links:int,chars:int>>"


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page with content: its host, a hash of its content, the hashes of its (slot, text) pairs, and letters and linked letters by slot."""
    known: dict = {}
    kind = pa.list_(pa.struct([("slot", pa.int64()), ("links", pa.int32()), ("chars", pa.int32())]))
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for host, page, wrapper in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = [b for b in blocks(page or "", wrapper, known) if b[3]]
            if own:
                made = [{"slot": _key(host, slot), "links": links, "chars": len(text) - text.count(" ")} for slot, text, links, *_ in own]
                for col, value in zip(rows, (host, _key(host, *(b[1] for b in own)), sorted({_key(host, b[0], b[1]) for b in own}), made), strict=True):
                    col.append(value)
        kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), kind)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["host", "page", "texts", "slots"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of content slots that are not constant, unless these are the lesser part of the page's content."""
    known: dict = {}
    for batch in batches:
        made = []
        hosts, pages, *told = (batch.column(i).to_pylist() for i in range(2, 8))
        for host, page, wrapper, constants, firms, menus in zip(hosts, pages, *told, strict=True):
            constants, firms, menus = (set(x or ()) for x in (constants, firms, menus))
            own = [b for b in blocks(page or "", wrapper, known) if b[3] and _key(host, b[0]) not in menus]
            vary = [b for b in own if _key(host, b[0], b[1]) not in (firms if b[4] else constants)]
            size = [sum(len(b[1]) for b in x) for x in (vary, own)]
            made.append("\n\n".join(b[1] for b in (vary if 2 * size[0] >= size[1] else own)))
        columns = [batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame, least_pages: int = 5) -> DataFrame:
    """page_id, url, text, n_chars of every page. Pages are parsed three times rather than written in between: for layouts, for counts, for their texts."""
    at = F.locate("://", "url")
    host = F.when(at > 0, F.lower(F.regexp_extract(F.expr("substring(url, locate('://', url) + 3)"), "^([^/?#]*)", 1))).otherwise("")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.select("page_id", "url", F.coalesce(host, F.lit("")).alias("host"), "html")

    counted = rows.select("host", "html").mapInArrow(_layouts, "host string, layout string").groupBy("host", "layout").agg(F.count("*").alias("n"))
    wrappers = materialise(counted.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("less"), "layout")).alias("w")).select("host", F.col("w.layout").alias("wrapper")), "wrappers")
    seen = materialise(rows.join(wrappers, "host", "left").select("host", "html", "wrapper").mapInArrow(_seen, _SEEN), "page-contents")

    different = seen.groupBy("page").agg(F.first("host").alias("host"), F.first("texts").alias("texts"))  # equal hosts and texts
    pages_of = different.groupBy("host").agg(F.count("*").alias("pages"))
    texts = different.select("host", F.explode("texts").alias("text")).groupBy("text").agg(F.first("host").alias("host"), F.count("*").alias("n"))
    constants = texts.filter(F.col("n") >= least_pages).join(pages_of, "host").filter("2 * n >= pages")
    firm = F.when(10 * F.col("n") >= 9 * F.col("pages"), F.col("text"))
    constants = constants.groupBy("host").agg(F.collect_list("text").alias("constants"), F.collect_list(firm).alias("firms"))
    slots = seen.select("host", F.explode("slots").alias("s")).groupBy("host", "s.slot").agg(F.sum("s.links").alias("links"), F.sum("s.chars").alias("chars"))
    menus = slots.filter("2 * links >= chars").groupBy("host").agg(F.collect_list("slot").alias("menus"))
    told = materialise(wrappers.join(constants, "host", "left").join(menus, "host", "left"), "templates")
    columns = ["page_id", "url", "host", "html", "wrapper", "constants", "firms", "menus"]
    return rows.join(told, "host", "left").select(*columns).mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def op12_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_texts(table(spark, sf_dir, "pages"))
