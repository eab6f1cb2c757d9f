"""Grade and subject scope as predicates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The science subjects whose lineage also holds general science.
BRANCHES = ("physics", "chemistry", "biology")
PRODUCTION = ("student_evidence", "teacher_strategy")


def offered(grade: int) -> tuple[str, ...]:
    """Subjects that a grade has."""
    if not 1 <= grade <= 12:
        raise ValueError("grade must be from 1 to 12")
    return ("mathematics",) if grade <= 2 else ("mathematics", "science") if grade <= 10 else ("mathematics", *BRANCHES)


def lineage(subject: str | None) -> tuple[str, ...]:
    """Subjects whose earlier material counts for a subject."""
    s = (subject or "").strip().lower()
    return () if not s else (s, "science") if s in BRANCHES else (s,)


@dataclass(frozen=True)
class Scope:
    """What a query may see; None does not restrict."""

    grade: int | None = None
    subject: str | None = None
    unit_id: str | None = None
    unit_title_contains: str | None = None
    resource_type: str | None = None
    audience: str | None = None
    document_id: str | None = None
    look_back: bool = False
    include_evaluation: bool = False

    def validate(self) -> Scope:
        if self.grade is None or not self.subject:
            raise ValueError("grade and subject are required")
        if self.subject.lower() not in offered(self.grade):
            raise ValueError(f"{self.subject} is not offered in grade {self.grade}")
        return self

    def predicate(self) -> Column:
        parts: list[Column] = []
        back = self.look_back and self.grade is not None and bool(self.subject)
        if self.grade is not None:
            parts.append(F.col("grade") <= self.grade if back else F.col("grade") == self.grade)
        if self.subject:
            parts.append(F.col("subject").isin(*lineage(self.subject)) if back else F.col("subject") == self.subject.lower())
        if self.unit_title_contains:
            parts.append(F.contains(F.lower("unit_title"), F.lit(self.unit_title_contains.lower())))
        for name in ("unit_id", "resource_type", "audience", "document_id"):
            if getattr(self, name) is not None:
                parts.append(F.col(name) == getattr(self, name))
        if not self.include_evaluation:
            parts.append(F.coalesce("content_partition", F.lit(PRODUCTION[0])).isin(*PRODUCTION))
        return reduce(lambda a, b: a & b, parts, F.lit(True))
