"""Sections packed into chunks of about a target size, with overlap.

Units are paragraphs; one over the ceiling is cut into sentence groups first. A chunk is a range of
units, so packing is a walk over the cumulative token counts of one section. Sections are cut inside
the document's row, so nothing is shuffled, and one section at a time is held by the Python helper.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import lines

SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])")
LEAST_CHARS = 80
SCHEMA = "doc_id long, section_index int, piece int, first_paragraph int, last_paragraph int, n_tokens int, text string"


class Budget(NamedTuple):
    target: int = 100
    overlap: int = 20
    least: int = 30
    most: int = 140


def count(text: str) -> int:
    """Estimated subword tokens, as ``functions.text.token_count``."""
    return max(1, round(len(text.split()) * 1.35))


def sentences(text: str) -> list[str]:
    return [s for s in map(str.strip, SENTENCE.split(text)) if s]


def tail(text: str, budget: int) -> str:
    """The last sentences within the budget, else the last words."""
    if budget <= 0:
        return ""
    for unit, parts in ((count, sentences(text)), (None, text.split()[-budget:])):
        for i in range(len(parts)):
            if (sum(map(unit, parts[i:])) if unit else count(" ".join(parts[i:]))) <= budget:
                return " ".join(parts[i:])
    return ""


def ranges(sizes: list[int], target: int, overlap: int = 0, carry=None) -> Iterator[tuple[int, int, str, int]]:
    """(from, to, prefix, tokens) of consecutive groups of up to ``target``; ``carry(i)`` gives the prefix where no unit fits the overlap."""
    ends = np.array([0, *accumulate(sizes)])
    low, prefix, carried = 0, "", 0
    for i in range(1, len(sizes)):
        if carried + ends[i + 1] - ends[low] > target:
            yield low, i, prefix, int(carried + ends[i] - ends[low])
            low = max(low, int(np.searchsorted(ends, ends[i] - overlap)))
            prefix = carry(i - 1) if low == i and carry else ""
            carried = count(prefix) if prefix else 0
    if sizes:
        yield low, len(sizes), prefix, int(carried + ends[-1] - ends[low])


def pack(paragraphs: list[str], b: Budget = Budget()) -> list[tuple[int, int, int, str]]:
    """(first paragraph, last paragraph, tokens, text) of the chunks of one section."""
    units: list[tuple[int, int, str]] = []
    for p, text in enumerate(paragraphs):
        parts = sentences(text) or [text]
        if (n := count(text)) <= b.most:
            units.append((p, n, text))
        else:
            units += [(p, n, " ".join(parts[x:y])) for x, y, _, n in ranges([count(s) for s in parts], b.target)]
    sizes = [n for _, n, _ in units]
    if sum(sizes) <= b.most:
        groups = [(0, len(units), "", sum(sizes))] if units else []
    else:
        groups = list(ranges(sizes, b.target, b.overlap, lambda i: tail(units[i][2], b.overlap)))
        if len(groups) > 1 and groups[-1][3] < b.least:  # a stub joins the chunk before it
            x, y, prefix, n = groups[-2]
            groups[-2:] = [(x, len(units), prefix, n + sum(sizes[y:]))]
    out = []
    for x, y, prefix, n in groups:
        text = "\n\n".join(([prefix] if prefix else []) + [u[2] for u in units[x:y]])
        if len(text) >= LEAST_CHARS and any(c.isalpha() for c in text):
            out.append((units[x - 1 if prefix else x][0], units[y - 1][0], n, text))
    return out


def packed_chunks(docs: DataFrame, section_lines: int = 10, budget: Budget = Budget()) -> DataFrame:
    """The chunks of (doc_id, text), of which every ``section_lines`` lines are a section; null and empty texts have none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lines(F.col("text")).alias("_l")).where(F.size("_l") > 0)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / section_lines).cast("int")), lambda i: F.slice("_l", i * section_lines + 1, section_lines))
    sections = rows.select("doc_id", F.posexplode(cut).alias("section_index", "paragraphs"))

    def run(batches):
        for batch in batches:
            out = []
            for doc, section, paragraphs in zip(batch["doc_id"], batch["section_index"], batch["paragraphs"], strict=True):
                first = section * section_lines
                for k, (x, y, n, text) in enumerate(pack(list(paragraphs), budget)):
                    out.append((doc, section, k, first + x, first + y, n, text))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in SCHEMA.split(", ")])

    return sections.mapInPandas(run, SCHEMA)
