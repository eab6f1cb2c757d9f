"""Language identification with a blended-spectrum string kernel.

The kernel of two texts counts the byte n-grams (n from 1 to 4, lower case, hashed to a fixed number
of places) that both have, over the root of the product of their own counts. ``LANDMARKS`` labelled
texts span the Nyström approximation; one-versus-rest ridge regression on the kernel with them gives a
weight for each landmark and language. As the kernel is a product of presence vectors, landmarks and
weights fold into one matrix, and scoring is a product of batches of presence vectors with it.

Bounds: at most ``SAMPLE`` labelled texts by order of a hash of their key, and of every language ``PER_LANGUAGE`` more, or as many as
keep these below ``MOST`` in all. Held-out rows count nowhere. Every text is then scored whole.

Defined results: a null text or one without a letter is ``und`` with score 0; rows are scored alone, so
repeated ones score alike; of a key that repeats in the sample the least (language, text) is learnt from; texts of any length are read whole; ties between
languages go to the first by name; a row without a key is scored but not learnt from; extra columns are ignored, whatever their names; without labels every
text is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import is_held_out, stored, table

SAMPLE, PER_LANGUAGE, MOST, LANDMARKS = 1200, 60, 12_000, 240
RIDGE = 0.1
FOLDS, HELD_OUT = 5, 0
WIDTHS = (256, 8192, 16384, 16384)
PLACES = sum(WIDTHS)
CHUNK = 1 << 20


def presence(text: str) -> np.ndarray:
    """Which hashed n-grams the whole text has."""
    out = np.zeros(PLACES, dtype=bool)
    every = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    for at in range(0, len(every), CHUNK):
        b = every[at : at + CHUNK + 3].astype(np.uint32)
        code, base = b, 0
        for n, width in enumerate(WIDTHS, 1):
            if n > 1:
                code = code[:-1] * np.uint32(257) + b[n - 1 :]
            if n == 1:
                out[code] = True
            else:
                out[base + ((code * np.uint32(2654435761)) >> np.uint32(32 - width.bit_length() + 1))] = True
            base += width
    return out


def labelled_sample(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang: the bounded sample to learn from."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~is_held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    # keys are chosen first, so that no text goes to the task that takes the least
    known = usable.select("doc_id", "lang", F.xxhash64(F.lit(6), "doc_id").alias("_order"))
    mixed = known.orderBy("_order", "doc_id").limit(SAMPLE).select("doc_id")
    # each task keeps its own first rows of a language before they are shuffled
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_order", "doc_id"))
    each = known.withColumn("_place", place).where(F.col("_place") <= PER_LANGUAGE).orderBy("_place", "_order", "doc_id").limit(MOST).select("doc_id")
    picked = F.broadcast(mixed.unionByName(each).distinct())  # at most SAMPLE + MOST keys
    rows = usable.select("doc_id", F.struct("lang", "text").alias("_row")).join(picked, "doc_id")
    return rows.groupBy("doc_id").agg(F.min("_row").alias("_row")).select("doc_id", "_row.text", "_row.lang")


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray, float]:
    """Languages, the folded matrix (place x language) and the sharpness of the scores."""
    sample = stored(labelled_sample(docs).orderBy(F.xxhash64("doc_id")), "languages")

    def vectors(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "bits": [np.packbits(presence(t)).tobytes() for t in batch["text"]]})

    rows = sample.mapInPandas(vectors, "doc_id long, lang string, bits binary").collect()  # bounded by SAMPLE and MOST
    if not rows:
        return [], np.zeros((PLACES, 0), np.float32), 1.0
    rows.sort(key=lambda r: (r["doc_id"] * 2654435761) % (1 << 32))
    langs = sorted({r["lang"] for r in rows})
    packed = np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1)

    def unit(at) -> np.ndarray:
        x = np.unpackbits(packed[at], axis=1)[:, :PLACES].astype(np.float32)
        return x / np.sqrt(x.sum(axis=1, keepdims=True))

    y = np.array([[1.0 if r["lang"] == g else 0.0 for g in langs] for r in rows])
    chosen = [i for g in range(len(langs)) for i in np.flatnonzero(y[:, g])[: max(1, LANDMARKS // len(langs))]]
    marks = unit(chosen)
    near = np.concatenate([unit(slice(i, i + 128)) @ marks.T for i in range(0, len(rows), 128)]).astype(np.float64)
    inner = (marks @ marks.T).astype(np.float64)
    weights = np.linalg.solve(near.T @ near + RIDGE * inner + 1e-6 * np.eye(len(chosen)), near.T @ y)
    folded = (marks.T @ weights.astype(np.float32)).astype(np.float32)
    raw, truth = near @ weights, y.argmax(axis=1)

    def loss(k: float) -> float:
        z = k * raw - (k * raw).max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean())

    return langs, folded, min((2.0, 4.0, 6.0, 8.0, 12.0), key=loss)


def classify(docs: DataFrame, model: tuple[list[str], np.ndarray, float], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with lang_pred and score."""
    langs, folded, sharp = model
    rows = docs.select(*keep, F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def judged(texts: list[str | None]) -> tuple[list[str], list[float]]:
        x = np.zeros((len(texts), PLACES), dtype=np.float32)
        for i, t in enumerate(texts):
            if t is not None:
                x[i] = presence(t)
        raw = sharp * (x @ folded) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        p = np.exp(raw - raw.max(axis=1, keepdims=True, initial=0))
        p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-30)
        best = p.argmax(axis=1) if langs else np.zeros(len(texts), int)
        known = [t is not None and bool(langs) for t in texts]
        names = [langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
        return names, [float(p[i, b]) if k else 0.0 for i, (b, k) in enumerate(zip(best, known, strict=True))]

    def score(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                names, scores = judged(batch.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"]
                )

    return rows.mapInArrow(score, f"{fields}, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return classify(docs, fit(docs)).withColumn("held_out", is_held_out(F.col("doc_id"), FOLDS, HELD_OUT))
