"""Ranked retrieval: lexical channels, rank fusion, reranking, selection, evidence gate, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.partitions import boilerplate
from marlstone.functions.scope import BRANCHES, PRODUCTION
from marlstone.functions.text import content_terms, query_terms, rule_terms, sigmoid, tokens
from marlstone.session import stored

K1, B = 1.2, 0.75
RRF_K = 60
FINAL = 5
GATE_CHECKS = ("candidates_exist", "reranked", "safe_partition", "reranker_confidence", "mutually_relevant_chunks", "scope_match", "query_term_overlap", "minimum_chunks")
QUERY_ROWS = 100_000


def queries_of(table_: DataFrame, key: str) -> DataFrame:
    """query_id, term: distinct terms of each query text."""
    return table_.select(F.col(key).alias("query_id"), F.explode(query_terms(F.col("text"))).alias("term"))


def ranked(rows: DataFrame, score: str, tie: str, k: int | None = None, group: str = "query_id") -> DataFrame:
    """``rows`` with ``rank`` by falling score; ties go to the lesser id; at most k a group."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie)))
    return out if k is None else out.where(F.col("rank") <= k)


def postings(docs: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term, tf, len: how often each wanted term stands in each document, stored once for all that ranks by it.

    One scan cuts the texts; only wanted terms leave it, and a row with term '' for each document, which carries its length for the statistics.
    """
    t = docs.select(key, tokens(F.coalesce("text", F.lit(""))).alias("t"))
    each = t.select(key, F.size("t").alias("len"), F.explode(F.concat(F.array(F.lit("")), "t")).alias("term"))
    vocabulary = wanted.select("term").unionByName(wanted.sparkSession.createDataFrame([("",)], "term string")).distinct()
    rows = each.join(vocabulary, "term", "left_semi").groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    return stored(rows, "postings")


def bm25(docs: DataFrame, wanted: DataFrame, key: str = "doc_id", k: int = 20, index: DataFrame | None = None) -> DataFrame:
    """query_id, key, score, rank: BM25 of every document that has a query term; ``index`` is what ``postings`` gives."""
    index = postings(docs, wanted, key) if index is None else index
    stats = index.where("term = ''").agg(F.count("*").alias("docs"), F.avg("len").alias("mean")).first()
    tf = index.where("term <> ''")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(stats["docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(stats["mean"] or 1.0)))
    scored = tf.join(df, "term").join(wanted, "term").groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score"))
    return ranked(scored, "score", key, k)


def coverage(docs: DataFrame, wanted: DataFrame, key: str = "doc_id", k: int = 20, index: DataFrame | None = None) -> DataFrame:
    """query_id, key, score, rank: share of the query's terms that a document has; ``index`` is what ``postings`` gives."""
    has = (postings(docs, wanted, key) if index is None else index).where("term <> ''").select(key, "term")
    size = wanted.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = has.join(wanted, "term").groupBy("query_id", key).agg(F.count("*").alias("c"))
    return ranked(hits.join(size, "query_id").select("query_id", key, F.round(F.col("c") / F.col("n"), 6).alias("score")), "score", key, k)


def in_blocks(wanted: DataFrame, run, key: str = "query_id") -> DataFrame:
    """``run`` on the query side in blocks by a hash of its key, of about ``QUERY_ROWS`` rows each; the results together."""
    count = max(1, -(-wanted.count() // QUERY_ROWS))
    block = F.pmod(F.xxhash64(key), F.lit(count))
    return reduce(DataFrame.unionByName, [run(wanted.where(block == i) if count > 1 else wanted) for i in range(count)])


def rrf(channels: dict[str, tuple[DataFrame, float]], key: str, k: int | None = 20) -> DataFrame:
    """query_id, key, rrf_score, rank, channel ranks: weighted reciprocal-rank fusion of ranked channels."""
    rows = None
    for name, (df, weight) in channels.items():
        one = df.select("query_id", key, F.lit(name).alias("channel"), (F.lit(weight) / (RRF_K + F.col("rank"))).alias("part"), F.col("rank").alias("r"))
        rows = one if rows is None else rows.unionByName(one)
    by_name = [F.max(F.when(F.col("channel") == n, F.col("r"))).alias(f"{n}_rank") for n in channels]
    fused = rows.groupBy("query_id", key).agg(F.round(F.sum("part"), 8).alias("rrf_score"), *by_name)
    return ranked(fused, "rrf_score", key, k)


def rerank(candidates: DataFrame, texts: DataFrame, questions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Candidates with ``logit`` (6 * coverage - 3 of the question's content terms), ``probability``, ``rerank`` and ``movement``."""
    q = questions.select("query_id", content_terms(F.col("text")).alias("q"))
    share = F.when(F.size("q") > 0, F.size(F.array_intersect("q", "t")) / F.size("q")).otherwise(0.0)
    # texts are cut into tokens where they have met their candidates
    scored = candidates.join(q, "query_id").join(texts.select(key, "text"), key).withColumn("t", tokens(F.col("text"))).drop("text").withColumn("logit", F.round(6 * share - 3, 6)).drop("q", "t")
    order = Window.partitionBy("query_id").orderBy(F.desc("logit"), "rank")
    out = scored.withColumns({"probability": F.round(sigmoid(F.col("logit")), 6), "rerank": F.row_number().over(order)})
    return out.withColumn("movement", F.col("rank") - F.col("rerank"))


def select_final(rows: DataFrame, floor: float | None = 0.0, limit: int = FINAL, key: str = "doc_id") -> DataFrame:
    """Tiered choice with reasons: adequate primary, adequate support, then weak ones to fill up."""
    adequate = F.lit(True) if floor is None else F.col("logit").isNull() | (F.col("logit") >= floor)
    primary = F.col("source_role") == "primary"
    tier = F.when(adequate & primary, 1).when(adequate, 2).when(primary, 3).otherwise(4)
    rows = rows.withColumn("tier", tier)
    any_first = F.max((F.col("tier") == 1).cast("int")).over(Window.partitionBy("query_id")) == 1
    reason = F.when(F.col("tier") == 1, "primary_adequate").when((F.col("tier") == 2) & any_first, "support_fills_gap").when(F.col("tier") == 2, "no_adequate_primary").otherwise("below_score_floor_fill")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "rerank", key))
    return rows.withColumn("reason", reason).withColumn("final_rank", place).where(F.col("final_rank") <= limit)


def gate(selected: DataFrame, questions: DataFrame, texts: DataFrame, floor: float = 0.0, overlap: float = 0.15, prior: float = 1.0, key: str = "doc_id") -> DataFrame:
    """A verdict for each question over its selected rows, with what the checks compare.

    ``questions`` have text, grade and subject, ``texts`` also content_partition (null counts as student evidence). Boilerplate and partitions that are not for students are not safe; of the
    safe rows those at the floor are strong, and if none is, the best one is, rather one in scope; strong rows in scope are kept, those of earlier grades below
    ``prior`` only if no row is of the question's own grade; the terms of the question are sought in all kept texts together. In mathematics terms of one exercise
    don't count, and a question that has no others passes. Without rows, or without safe ones, confidence is none; without scores it is unknown.
    """
    terms, maths = content_terms(F.col("text")), F.coalesce(F.col("subject") == "mathematics", F.lit(False))
    q = questions.select("query_id", F.col("grade").alias("q_grade"), F.col("subject").alias("q_subject"), F.when(maths, rule_terms(terms)).otherwise(terms).alias("q"))
    rows = selected.select("query_id", key, "logit", "final_rank").join(q.drop("q"), "query_id").join(texts.select(key, "text", "grade", "subject", "content_partition"), key)
    production = F.coalesce("content_partition", F.lit("student_evidence")).isin(*PRODUCTION)
    lineage = (F.col("subject") == F.col("q_subject")) | (F.col("q_subject").isin(*BRANCHES) & (F.col("subject") == "science"))
    rows = rows.select(
        "query_id", "logit", "final_rank", tokens(F.col("text")).alias("t"), (~boilerplate(F.col("text")) & production & F.col("logit").isNotNull()).alias("safe"),
        (F.col("grade") == F.col("q_grade")).alias("is_current"), F.coalesce((F.col("grade") <= F.col("q_grade")) & lineage, F.lit(False)).alias("inside"),
    )
    each = Window.partitionBy("query_id")
    first = F.row_number().over(Window.partitionBy("query_id", "safe").orderBy(F.desc("inside"), F.desc("logit"), "final_rank")) == 1
    promoted = (F.max(F.when(F.col("safe"), F.col("logit"))).over(each) < floor) & first
    rows = rows.withColumn("strong", F.col("safe") & ((F.col("logit") >= floor) | promoted)).withColumn("scoped", F.col("strong") & F.col("inside"))
    any_current = F.max(F.col("scoped") & F.col("is_current")).over(each)
    rows = rows.withColumn("keep", F.col("scoped") & (F.col("is_current") | ~any_current | (F.col("logit") >= prior)))
    count = lambda c: F.sum(c.cast("long"))
    sums = rows.groupBy("query_id").agg(
        F.count("*").alias("n"), F.count("logit").alias("n_scored"), count(F.col("safe")).alias("n_safe"), F.max(F.when(F.col("safe"), F.col("logit"))).alias("top"),
        count(F.col("strong")).alias("n_strong"), count(F.col("keep")).alias("n_kept"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("keep"), F.col("t"))))).alias("t"),
    )
    counts = ("n", "n_scored", "n_safe", "n_strong", "n_kept")
    out = q.join(sums, "query_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    skipped = F.coalesce(F.col("q_subject") == "mathematics", F.lit(False)) & (F.size("q") == 0)
    share = F.when(skipped, 1.0).when((F.size("q") > 0) & (F.col("n_kept") > 0), F.size(F.array_intersect("q", "t")) / F.size("q")).otherwise(0.0)
    out = out.withColumn("overlap", F.round(share, 6))
    good = (F.col("n_scored") > 0) & (F.col("n_safe") > 0) & (F.col("n_strong") >= 1) & (F.col("n_kept") > 0) & (F.col("overlap") >= overlap)
    level = F.when(F.col("n") == 0, "none").when(F.col("n_scored") == 0, "unknown").when(F.col("n_safe") == 0, "none").when(~good, "insufficient").when((F.col("top") >= 4) & (F.col("n_strong") >= 3), "high").when(F.col("top") >= 1, "medium").otherwise("low")
    return out.select("query_id", "n", "n_scored", "n_safe", "top", "n_strong", "n_kept", "overlap", good.alias("sufficient"), level.alias("confidence"))


def gate_checks(verdicts: DataFrame, overlap: float = 0.15, least_strong: int = 1, least_kept: int = 1) -> DataFrame:
    """query_id, check_name, passed, value: a row for each check that is made. Without rows, without scores or without safe rows the checks end there."""
    n = lambda c: F.col(c).cast("double")
    checks = (
        (F.col("n") > 0, n("n")), (F.col("n_scored") > 0, n("n_scored")), (F.col("n_safe") > 0, n("n_safe")), (F.col("n_strong") >= 1, n("top")), (F.col("n_strong") >= least_strong, n("n_strong")),
        (F.col("n_kept") > 0, n("n_kept")), (F.col("overlap") >= overlap, F.round("overlap", 4)), (F.col("n_kept") >= least_kept, n("n_kept")),
    )
    made = F.when(F.col("n") == 0, 1).when(F.col("n_scored") == 0, 2).when(F.col("n_safe") == 0, 3).otherwise(len(checks))
    every = F.array(*[F.struct(F.lit(name).alias("check_name"), passed.alias("passed"), value.alias("value")) for name, (passed, value) in zip(GATE_CHECKS, checks, strict=True)])
    return verdicts.select("query_id", F.explode(F.slice(every, 1, made)).alias("c")).select("query_id", "c.*")


def merge_candidates(channels: dict[str, tuple[DataFrame, float]], key: str) -> DataFrame:
    """One row for each candidate of any channel: score and rank in each, the fused score, a map of what each channel gives, and the strongest channel."""
    rows = None
    for name, (df, weight) in channels.items():
        part = F.lit(weight) / (RRF_K + F.col("rank"))
        one = df.select("query_id", key, F.lit(name).alias("channel"), "score", F.col("rank").alias("r"), part.alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    scores = [F.max(F.when(F.col("channel") == n, F.col("score"))).alias(f"{n}_score") for n in channels]
    ranks = [F.max(F.when(F.col("channel") == n, F.col("r"))).alias(f"{n}_rank") for n in channels]
    given = F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", F.round("part", 8).alias("part")))))
    merged = rows.groupBy("query_id", key).agg(*scores, *ranks, F.round(F.sum("part"), 8).alias("rrf_score"), given.alias("contributions"), F.max_by("channel", F.struct("part", "channel")).alias("best_channel"))
    return merged.select("query_id", key, *[f"{n}_score" for n in channels], *[f"{n}_rank" for n in channels], "rrf_score", "contributions", "best_channel")


def told(contributions: Column) -> Column:
    """A map of contributions as text, in units of 1e-8."""
    return F.array_join(F.transform(F.map_entries(contributions), lambda e: F.concat_ws("=", e["key"], F.round(e["value"] * 1e8).cast("long").cast("string"))), ",")


def holding(docs: DataFrame, questions: DataFrame, key: str = "doc_id") -> DataFrame:
    """query_id, key: the documents that contain a question's text.

    Every token inside a question, between its first and its last, is a token of such a document. So the rarest of these leads to
    the candidates, which are then tested; only questions of one or two tokens are held against all documents.
    """
    t = tokens(F.col("text"))
    q = questions.where("text IS NOT NULL").withColumn("_inner", F.array_distinct(F.slice(t, 2, F.greatest(F.size(t) - 2, F.lit(0)))))
    terms = q.select("query_id", F.explode("_inner").alias("term"))
    has = docs.select(key, F.explode(F.array_distinct(t)).alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    counts = has.groupBy("term").agg(F.count("*").alias("df"))
    # a term that no document has leaves its question without candidates
    lead = terms.join(counts, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    pairs = has.join(lead, "term").select("query_id", key)
    texts = q.select("query_id", F.col("text").alias("_q"))
    found = pairs.join(texts, "query_id").join(docs.select(key, "text"), key).where(F.contains("text", F.col("_q"))).select("query_id", key)
    short = q.where(F.size("_inner") == 0).select("query_id", F.col("text").alias("_q"))
    return found.unionByName(in_blocks(short, lambda part: docs.join(F.broadcast(part), F.contains("text", F.col("_q"))).select("query_id", key)))


def ir_metrics(results: DataFrame, relevant: DataFrame, key: str = "doc_id", k: int = 20) -> DataFrame:
    """recall, mrr and ndcg at k averaged over the queries that have labels (query_id, key, gain)."""
    found = results.where(F.col("rank") <= k).join(relevant, ["query_id", key])
    gain: Column = (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(F.col("rank") + 1)
    got = found.groupBy("query_id").agg(F.count("*").alias("hits"), F.max(1 / F.col("rank")).alias("rr"), F.sum(gain).alias("dcg"))
    order = Window.partitionBy("query_id").orderBy(F.desc("gain"), key)
    best = relevant.withColumn("rank", F.row_number().over(order))
    ideal = best.groupBy("query_id").agg(F.count("*").alias("total"), F.sum(F.when(F.col("rank") <= k, gain)).alias("idcg"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(got, "query_id", "left").agg(
        F.count("*").alias("n_queries"),
        F.round(F.avg(zero(F.col("hits") / F.col("total"))), 4).alias("recall"),
        F.round(F.avg(zero(F.col("rr"))), 4).alias("mrr"),
        F.round(F.avg(zero(F.col("dcg") / F.col("idcg"))), 4).alias("ndcg"),
    )


def hashed_embeddings(docs: DataFrame, key: str = "doc_id", dims: int = 64) -> DataFrame:
    """key, dim, value: signed feature hashing of the tokens to ``dims`` places, of length one; places of zero are left out.

    Counts are combined before the shuffle, so at most ``dims`` rows a document leave a task.
    """
    h = F.conv(F.substring(F.md5("t"), 1, 4), 16, 10).cast("int")
    each = docs.select(key, F.explode(tokens(F.col("text"))).alias("t")).select(key, (h % dims).alias("dim"), F.when(F.floor(h / dims) % 2 == 0, 1).otherwise(-1).alias("sign"))
    rows = each.groupBy(key, "dim").agg(F.sum("sign").alias("v")).where("v <> 0")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return rows.select(key, "dim", F.round(F.col("v") / norm, 6).alias("value"))
