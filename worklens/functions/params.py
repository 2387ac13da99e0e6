"""Parameters that reports share. "Now" is always an explicit ``as_of``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status sets, type sets and label spellings of the reports.
ACTIVE = ("In Progress", "Blocked", "On Hold", "Validating", "Reviewing", "Staged CAR")
WIP = ("In Progress", "Blocked", "On Hold", "Validating", "Staged CAR")
QUEUE = ("Triage", "Reviewing")
#: Statuses that "open" reports leave out, spelled as in the tracker.
EXCLUDED_STATUSES = (
    "Technical Debt", "Done", "Backlog", "Plan Release", "Prepare Release", "Will Not Do", "Blocked For Development", "Resource Constrained",
    "Released Successfully to Production", "❌ Rolled Back",
)
#: Statuses that the age report leaves out, and those that its view by status leaves out besides.
AGE_EXCLUDED = (
    "Done", "Will Not Do", "Released Successfully to Production", "❌ Rolled Back", "Prepare Release", "Plan Release", "Post Implementation Review", "Deploy Release", "Test and Validate", "Review Release Plan",
)
AGE_EXCLUDED_BY_STATUS = ("Resource Constrained", "Blocked For Development", "Plan Release", "Technical Debt")
#: Backlog of the size report, lower-cased.
SIZE_BACKLOG = ("to do", "tech discovery required")
#: Scope of a delivery item's children.
TERMINAL, TODO, IN_PROGRESS = ("Done", "Will Not Do"), ("To Do", "Tech Discovery Required", "Triage"), ("In Progress", "Validating")
#: Rules of the personal report in order, with their ranks; any other issue shows its status, at rank 8.
ATTENTION = (
    ("Blocked", 0), ("On Hold", 1), ("Validating", 2), ("Overdue", 3), ("Due Soon", 4), ("Missing Target", 5), ("High Priority", 6), ("In Progress", 7), ("Done", 9),
)
ATTENTION_OTHER = 8
ATTENTION_PRIORITIES = ("critical", "urgent", "high", "medium", "low", "no priority")
DELIVERY_TYPES = ("Story", "Task", "Bug", "Hotfix", "Sub-task")
PRIORITIES = ("Urgent", "High", "Medium", "Low", "None")
SIZES = ("Small", "Medium", "Large", "XL", "Unestimated")
SLA_STATUSES = ("in progress", "on hold", "blocked", "to do", "validating", "tech discovery required")
#: Statuses that count as closed for service levels, lower-cased, and as done in trends and in capacity.
CLOSED_STATUSES = ("done", "closed", "resolved", "complete", "completed")
TREND_DONE = ("Done", "Released Successfully to Production", "Closed", "Resolved")
CAPACITY_DONE = ("Done", "Released Successfully to Production")
SLA_DAYS = {"Urgent": 90.0, "High": 90.0, "Medium": 90.0, "Low": 90.0}
#: (profile, raw, canonical); raw is trimmed and lower-cased, for "sla" without blanks as well. All others are None. The three report families disagree on purpose.
PRIORITY_MAP = tuple(
    (profile, raw, canonical)
    for profile, spellings in {
        "sla": {"Urgent": ("highest", "critical", "urgent", "blocker", "p1", "prio1"), "High": ("high", "p2", "prio2"), "Medium": ("medium", "p3", "prio3"), "Low": ("low", "p4", "prio4")},
        "velocity": {"Urgent": ("urgent", "highest", "critical"), "High": ("high",), "Medium": ("medium",), "Low": ("low",)},
        "executive": {"Urgent": ("urgent", "highest"), "High": ("high",), "Medium": ("medium",), "Low": ("low",)},
    }.items()
    for canonical, raws in spellings.items()
    for raw in raws
)


@dataclass(frozen=True)
class Params:
    as_of: str = "2001-09-15 12:00:00"
    business_tz: str = "America/Denver"
    local_offset: str = "-06:00"
    change_project: str = "CAR"
    change_lead: str = "Release Lead"
    base_url: str = "https://tracker.example/browse/"
    window_days: int = 90
    team: tuple = field(default=tuple(f"Engineer {i}" for i in range(10)))
    excluded: tuple = ("Engineer 10",)

    def now(self) -> Column:
        return F.expr(f"TIMESTAMP_NTZ '{self.as_of}'")

    def cutoff(self, days: int | None = None) -> Column:
        """Start of the day ``days`` (the window) before now."""
        return F.date_trunc("day", self.now()).cast("timestamp_ntz") - F.expr(f"INTERVAL '{days or self.window_days}' DAY")


DEFAULT = Params()
