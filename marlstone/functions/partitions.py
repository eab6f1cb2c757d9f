"""Rule-based classification of text sections into content partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrase families of the rules, in the order they are tried.
EVALUATION_HEADING = (
    r"(?i)(answer\s*key|worked\s+solutions?|sample\s+responses?|acceptable\s+answers?|mid[\s-]*module\s+assessment|"
    r"end[\s-]*of[\s-]*module\s+assessment|assessment\s+(task|summary)|evaluation\s+rubric|possible\s+solutions?|"
    r"exit\s+ticket\s+(sample|answers?)|homework\s+(answer|solution)|marking\s+guide|scoring\s+rubric|\bsolutions?\b|"
    r"^answers$|^answers\s+(to|of)\b)"
)
PRACTICE_HEADING = (
    r"(?i)(exit\s+ticket|homework|problem\s+set|sprint\b|practice\s+set|fluency\s+sprints?|application\s+problem|unsolved|"
    r"independent\s+practice|^exercises?\b|let['’]?s\s+practi[sc]e|let\s+us\s+practi[sc]e|try\s+these)"
)
STRATEGY_HEADING = (
    r"(?i)^(notes\s+on|scaffolding|concept\s+development|fluency\s+practice|student\s+debrief|misconception|questioning|"
    r"pedagogy|teacher\s+note|notes\s+for\s+teachers)\b"
)
BOILERPLATE_HEADING = (
    r"(?i)(credits?\s+and\s+copyright|credits?$|copyright|creative\s+commons|acknowledg|isbn|table\s+of\s+contents|^contents$|"
    r"about\s+the\s+authors?|publication\s+information|license\s+notice|licensing)"
)
BOILERPLATE_BODY = (
    r"(?i)(this work is licensed under a creative commons|creative commons attribution|"
    r"unless otherwise noted, the contents of this book are licensed|©\s*copyright|all rights reserved|isbn[-\s]?\d|"
    r"great minds\.?\s*eureka-math|nys common core|https?://creativecommons\.org|https?://ncert\.nic\.in|"
    r"national council of educational research|https?://greatminds\.org)"
)
SOLUTION_BODY = (
    r"(?i)(sample\s+response|acceptable\s+answer|answers?\s+will\s+vary|the\s+correct\s+answer\s+is|answer\s*key|"
    r"students?\s+should\s+(have\s+)?(written|said|got|answered)|expected\s+response)"
)
FOOTER = r"(?i)this work is licensed under a creative commons"
URL = r"(?i)https?://"


def boilerplate(text: Column) -> Column:
    """Notices rather than content: by heading, by links, by footer or by phrases in a short text."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    urls, hits = F.regexp_count(text, F.lit(URL)), F.regexp_count(text, F.lit(BOILERPLATE_BODY))
    return (
        F.regexp_like(F.substring(text, 1, 120), F.lit(BOILERPLATE_HEADING))
        | ((urls >= 3) & (urls > words * F.lit(0.04)))
        | (F.regexp_like(text, F.lit(FOOTER)) & (F.length(text) < 900))
        | ((hits > 0) & ((F.length(text) < 700) | (hits >= 2) | (words < 80)))
    )


def partition(title: Column, text: Column, before: Column, default: str = "student_evidence") -> Column:
    """Partition of a section by its heading, its text and the heading before it; the first rule that holds decides."""
    heading = lambda c, p: F.regexp_like(F.trim(F.coalesce(c, F.lit(""))), F.lit(p))
    return (
        F.when(boilerplate(text), "excluded_boilerplate")
        .when(heading(title, EVALUATION_HEADING), "evaluation_only")
        .when(F.regexp_like(F.substring(text, 1, 1500), F.lit(SOLUTION_BODY)), "evaluation_only")
        .when(F.regexp_like(F.coalesce(before, F.lit("")), F.lit(r"(?i)answer\s*key")), "evaluation_only")
        .when(heading(title, STRATEGY_HEADING), "teacher_strategy")
        .when(heading(title, PRACTICE_HEADING), "practice_only")
        .when(heading(title, BOILERPLATE_HEADING), "excluded_boilerplate")
        .otherwise(default)
    )
