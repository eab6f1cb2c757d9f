"""Queries on the chunk graph: seeds from retrieval, expansion, ranking, and the trace."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.functions.partitions import partition
from marlstone.operators import graph as gr
from marlstone.operators import lexical as lx
from marlstone.operators import retrieval as rt
from marlstone.plans import queries as q
from marlstone.plans.queries import query
from marlstone.session import stored, table
from marlstone.sources import corpus

#: Concepts of more mentions are hubs here; the given tables are smaller than the corpora that ``graph.HUB`` is for.
HUBS = 200

_SUBJECT = (
    "CASE WHEN 1 + item_id % 12 <= 2 THEN 'mathematics' WHEN 1 + item_id % 12 <= 10 THEN ['mathematics', 'science'][CAST((item_id // 12) % 2 + 1 AS INT)] "
    "ELSE ['mathematics', 'physics', 'chemistry', 'biology'][CAST((item_id // 12) % 4 + 1 AS INT)] END"
)
_RANKED = "SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {}) WHERE rank <= 20"
_SEEDS = (
    q._CLASSIFIED
    + q._VOCAB[len(q._CHUNKS) :]
    + f""",
requests AS (SELECT item_id AS query_id, CAST(1 + item_id % 12 AS INT) AS q_grade, {_SUBJECT} AS q_subject, {q._CONTENT} AS q FROM benchmark),
cq AS (SELECT item_id AS query_id, unnest({q._terms(q._TOK)}) AS term FROM benchmark),
ctoks AS (SELECT chunk_id, {q._TOK} AS t FROM chunks),
cstats AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM ctoks),
ctf AS (SELECT chunk_id, term, count(*) AS tf, any_value(n) AS len FROM (SELECT chunk_id, len(t) AS n, unnest(t) AS term FROM ctoks) WHERE term IN (SELECT term FROM cq) GROUP BY 1, 2),
cdf AS (SELECT term, count(*) AS df FROM ctf GROUP BY 1),
cbm AS (SELECT query_id, chunk_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score FROM ctf JOIN cdf USING (term) JOIN cq USING (term), cstats GROUP BY 1, 2),
clex AS MATERIALIZED ({_RANKED.format("cbm")}),
cn AS (SELECT query_id, count(*) AS n FROM cq GROUP BY 1),
ccv AS (SELECT query_id, chunk_id, round(count(*) / any_value(n), 6) AS score FROM ctf JOIN cq USING (term) JOIN cn USING (query_id) GROUP BY 1, 2),
ccov AS MATERIALIZED ({_RANKED.format("ccv")}),
chits AS (SELECT query_id, chunk_id, rank FROM clex UNION ALL SELECT query_id, chunk_id, rank FROM ccov),
seeds AS MATERIALIZED (SELECT query_id, seed_id, weight, CAST(seed_rank AS INT) AS seed_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, seed_id) AS seed_rank
  FROM (SELECT query_id, chunk_id AS seed_id, round(max(1.0::DOUBLE / rank), 6) AS weight FROM chits GROUP BY 1, 2)) WHERE seed_rank <= 10),
hubs AS (SELECT concept, count(*) AS mention_count FROM mentions GROUP BY 1 HAVING count(*) > {HUBS}),
known AS (SELECT chunk_id, concept FROM mentions WHERE concept NOT IN (SELECT concept FROM hubs)),
pages_of AS (SELECT chunk_id, document_id || printf(':p%04d', p) AS page_id FROM (SELECT chunk_id, document_id, unnest(range(page_start, page_end + 1)) AS p FROM chunks))"""
)


def _expansion(name: str, seeds: str, limit: int) -> str:
    """CTE ``name``: the neighbours of the chunks in ``seeds`` (seed_id)."""
    return f""",
s_{name} AS (SELECT * FROM chunks WHERE chunk_id IN (SELECT seed_id FROM {seeds})),
r_{name} AS (
  SELECT s.chunk_id AS seed_id, 'SAME_SECTION' AS relation, c.chunk_id, CAST(NULL AS VARCHAR) AS via FROM s_{name} s JOIN chunks c USING (section_id) WHERE c.chunk_id <> s.chunk_id
  UNION SELECT s.chunk_id, 'ADJACENT', c.chunk_id, NULL FROM s_{name} s JOIN chunks c ON c.document_id = s.document_id AND abs(c.chunk_index - s.chunk_index) = 1
  UNION SELECT s.chunk_id, 'SAME_PAGE', b.chunk_id, b.page_id FROM s_{name} s JOIN pages_of a USING (chunk_id) JOIN pages_of b ON a.page_id = b.page_id WHERE b.chunk_id <> s.chunk_id
  UNION SELECT s.chunk_id, 'SHARED_CONCEPT', b.chunk_id, b.concept FROM s_{name} s JOIN known a USING (chunk_id) JOIN known b ON a.concept = b.concept WHERE b.chunk_id <> s.chunk_id
  UNION SELECT s.chunk_id, 'SAME_LESSON', c.chunk_id, NULL FROM s_{name} s JOIN chunks c ON c.unit_id = s.unit_id AND c.section_title = s.section_title AND c.document_id <> s.document_id),
{name} AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY seed_id, relation ORDER BY chunk_id, via NULLS FIRST) AS INT) AS position FROM r_{name}) WHERE position <= {limit})"""


_CASES = lambda values: "CASE relation " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"
_WEIGHT = _CASES(gr.RELATIONS)
_PATHS = _SEEDS + _expansion("paths", "seeds", gr.PER_RELATION)
_REQUESTED = (
    _SEEDS
    + _expansion("every", "seeds", gr.TRACE_LIMIT + 1)
    + f""",
placed AS (SELECT query_id, seed_id, weight, relation, e.chunk_id, via, position, seed_rank, {_CASES(gr.RELATION_NUMBER)} AS rel, c.grade > q_grade AS late,
    NOT (c.subject = q_subject OR (q_subject IN ('physics', 'chemistry', 'biology') AND c.subject = 'science')) AS strange, {q._SAFE} AS safe, c.grade, c.subject, q_grade, q_subject
  FROM seeds JOIN every e USING (seed_id) JOIN classified c ON c.chunk_id = e.chunk_id JOIN requests USING (query_id)),
rows_ AS MATERIALIZED (SELECT *, NOT late AND NOT strange AS inside, position <= 8 AND NOT late AND NOT strange AND safe AS is_primary,
    concat_ws('; ', CASE WHEN late THEN 'grade ' || grade || ' > ' || q_grade END, CASE WHEN strange THEN 'subject ' || subject || ' not in lineage ' || q_subject END) AS detail FROM placed),
ordered_ AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY NOT is_primary, seed_rank, rel, position) AS seq FROM rows_),
reached AS (SELECT * FROM ordered_ o WHERE is_primary AND NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = o.query_id AND s.seed_id = o.chunk_id)),
gsum AS (SELECT query_id, chunk_id, round(sum(weight * {_WEIGHT}), 6) AS score, count(*) AS n_paths, arg_min(seed_id, seq) AS first_seed,
    array_to_string(list(relation || CASE WHEN via IS NULL THEN '' ELSE ' via ' || via END || ' from ' || seed_id ORDER BY seq)[1:3], '; ') AS path FROM reached GROUP BY 1, 2),
granked AS MATERIALIZED (SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank, n_paths, first_seed, path FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM gsum) WHERE rank <= 20)"""
)
_FUSED = (
    _REQUESTED
    + """,
parts3 AS (SELECT query_id, chunk_id, 'fulltext' AS channel, rank, score, 1.0 / (60 + rank) AS part FROM clex UNION ALL SELECT query_id, chunk_id, 'coverage', rank, score, 0.5 / (60 + rank) FROM ccov
  UNION ALL SELECT query_id, chunk_id, 'graph', rank, score, 0.5 / (60 + rank) FROM granked),
fused3 AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS INT) AS rank FROM (SELECT query_id, chunk_id, round(sum(part), 8) AS rrf_score FROM parts3 GROUP BY 1, 2) QUALIFY rank <= 20),
logit3 AS (SELECT f.*, round(6 * CASE WHEN len(q) > 0 THEN len(list_intersect(q, list_distinct(t))) / len(q) ELSE 0 END - 3, 6) AS logit FROM fused3 f JOIN requests USING (query_id) JOIN ctoks USING (chunk_id)),
rerank3 AS (SELECT l.*, row_number() OVER (PARTITION BY query_id ORDER BY logit DESC, rank) AS rerank, source_role FROM logit3 l JOIN chunks USING (chunk_id)),
evidence3 AS MATERIALIZED (SELECT query_id, chunk_id, logit, CAST(final_rank AS INT) AS final_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN logit >= 0 AND source_role = 'primary' THEN 1 WHEN logit >= 0 THEN 2 WHEN source_role = 'primary' THEN 3 ELSE 4 END, rerank, chunk_id) AS final_rank FROM rerank3) WHERE final_rank <= 5)"""
)
_TRACED = (
    _FUSED
    + f""",
marked AS (SELECT o.*, NOT is_primary AND position > 50 AS cut, EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = o.query_id AND s.seed_id = o.chunk_id) AS is_seed,
    EXISTS (SELECT 1 FROM granked g WHERE g.query_id = o.query_id AND g.chunk_id = o.chunk_id) AS is_chosen FROM ordered_ o),
counted AS (SELECT *, row_number() OVER (PARTITION BY query_id, cut, chunk_id ORDER BY seq) AS nth FROM marked),
traced AS MATERIALIZED (SELECT *, CASE WHEN cut THEN 'TRACE_SAFETY_LIMIT' WHEN is_seed THEN 'SEED_NODE' WHEN NOT is_primary AND NOT inside THEN 'METADATA_FILTER_MISMATCH' WHEN NOT is_primary AND position > 8 THEN 'PER_RELATION_LIMIT'
    WHEN is_chosen AND nth = 1 THEN 'SELECTED_GRAPH_CANDIDATE' WHEN is_chosen THEN 'DUPLICATE_PATH' ELSE 'GRAPH_TOP_K_CUTOFF' END AS reason, CASE WHEN cut THEN 0 ELSE round(weight * {_WEIGHT}, 6) END AS contribution FROM counted),
hub_rows AS MATERIALIZED (SELECT query_id, seed_id, concept, mention_count FROM seeds JOIN mentions m ON m.chunk_id = seed_id JOIN hubs USING (concept))"""
)


@dataclass
class Graph:
    """The chunk graph of the given tables and what the requests of ``benchmark`` make of it; each part is stored where several others use it."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def chunks(self) -> DataFrame:
        wanted = ("chunk_id", "doc_id", "document_id", "unit_id", "grade", "subject", "source_role", "chunk_index", "section_id", "section_title", "title_before", "page_start", "page_end", "text")
        return stored(corpus.chunks(self.spark, self.sf_dir, "title_before").select(*wanted), "chunks")

    @cached_property
    def mentions(self) -> DataFrame:
        """All mentions of all chunks; the queries here only take those of ``concepts_of`` and ``mentions_of``."""
        return stored(q._mentions(self.chunks), "mentions")

    @cached_property
    def counts(self) -> DataFrame:
        return lx.term_counts(self.chunks)

    @cached_property
    def vocabulary(self) -> DataFrame:
        """concept, mention_count: of each concept. The titles are made distinct before they are cut into words."""
        found = F.array_distinct(F.regexp_extract_all(F.lower("section_title"), F.lit(r"[\p{L}]{5,}"), F.lit(0)))
        words = self.chunks.select("section_title").distinct().select(F.explode(found).alias("concept")).where(~F.col("concept").isin(*tx.STOP_WORDS))
        known = words.groupBy("concept").agg(F.count("*").alias("support")).where("support >= 2").select("concept")
        return stored(known.join(self.counts.select(F.col("term").alias("concept"), F.col("df").alias("mention_count")), "concept"), "vocabulary")

    def rows_of(self, ids: DataFrame, *columns: str | Column) -> DataFrame:
        """The chunks of ``ids`` (chunk_id, each once), stored; ``columns`` are made of these chunks alone."""
        return stored(rt.in_blocks(ids, lambda part: self.chunks.join(F.broadcast(part), "chunk_id", "left_semi").select(*(columns or "*")), "chunk_id"), "rows")

    def concepts_of(self, rows: DataFrame) -> DataFrame:
        """chunk_id, concept, mention_count: the concepts in the texts of a few chunks, stored."""
        each = rows.select("chunk_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("concept"))
        return stored(each.join(self.vocabulary, "concept").select("chunk_id", "concept", "mention_count"), "concepts")

    def mentions_of(self, concepts: DataFrame) -> DataFrame:
        """chunk_id, concept: every mention of ``concepts`` (concept, each once), stored; all texts are scanned, and nothing else leaves the scan."""
        each = self.chunks.select("chunk_id", F.explode(tx.tokens(F.col("text"))).alias("concept"))
        return stored(rt.in_blocks(concepts, lambda part: each.join(F.broadcast(part), "concept", "left_semi"), "concept").distinct(), "mentions")

    @cached_property
    def channels(self) -> dict[str, DataFrame]:
        return lx.channels(self.chunks.select("chunk_id", "text"), q._wanted(self.spark, self.sf_dir), self.counts, "chunk_id")

    @cached_property
    def seeds(self) -> DataFrame:
        return stored(gr.select_seeds(list(self.channels.values())), "seeds")

    @cached_property
    def seed_rows(self) -> DataFrame:
        return self.rows_of(self.seeds.select(F.col("seed_id").alias("chunk_id")).distinct())

    @cached_property
    def seed_concepts(self) -> DataFrame:
        return self.concepts_of(self.seed_rows)

    @cached_property
    def requests(self) -> DataFrame:
        asked = table(self.spark, self.sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("").alias("source"), "text")
        return corpus.with_lineage(asked).select(F.col("doc_id").alias("query_id"), "text", F.col("grade").alias("q_grade"), F.col("subject").alias("q_subject"))

    def neighbours(self, seeds: DataFrame, limit: int = gr.PER_RELATION) -> DataFrame:
        own = seeds is self.seeds
        rows = self.seed_rows if own else self.rows_of(seeds.select(F.col("seed_id").alias("chunk_id")).distinct())
        concepts = self.seed_concepts if own else self.concepts_of(rows)
        known = self.mentions_of(stored(concepts.where(F.col("mention_count") <= HUBS).select("concept").distinct(), "known"))
        return gr.expand(rows.select(F.col("chunk_id").alias("seed_id")), self.chunks, corpus.on_page(self.chunks), known, limit, seed_rows=rows)

    @cached_property
    def requested(self) -> DataFrame:
        paths = stored(self.neighbours(self.seeds, gr.TRACE_LIMIT + 1), "paths")
        kind = partition(F.col("section_title"), F.col("text"), F.col("title_before")).alias("content_partition")
        scope = self.rows_of(stored(paths.select("chunk_id").distinct(), "reached"), "chunk_id", "grade", "subject", kind)
        return stored(gr.requested(paths, self.seeds, scope, self.requests), "requested")

    @cached_property
    def ranked(self) -> DataFrame:
        return stored(gr.graph_ranked(self.requested, self.seeds), "ranked")

    @property
    def all_channels(self) -> dict[str, tuple[DataFrame, float]]:
        return {"fulltext": (self.channels["fulltext"], 1.0), "coverage": (self.channels["coverage"], 0.5), "graph": (self.ranked, 0.5)}

    @cached_property
    def fused(self) -> DataFrame:
        return stored(rt.rrf(self.all_channels, "chunk_id"), "fused")

    @cached_property
    def evidence(self) -> DataFrame:
        rows = self.rows_of(self.fused.select("chunk_id").distinct())
        scored = rt.rerank(self.fused, rows.select("chunk_id", "text"), self.requests, "chunk_id").join(rows.select("chunk_id", "source_role"), "chunk_id")
        return rt.select_final(scored, key="chunk_id")

    @cached_property
    def traced(self) -> DataFrame:
        return stored(gr.classify(self.requested, self.seeds, self.ranked), "traced")

    @cached_property
    def hub_rows(self) -> DataFrame:
        hubs = self.seed_concepts.where(F.col("mention_count") > HUBS)
        return gr.hub_rows(self.seeds, hubs, hubs.select("concept", "mention_count").distinct())


@query(f"WITH {_SEEDS} SELECT query_id, seed_id, weight, seed_rank FROM seeds")
def graph_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(spark, sf_dir).seeds


@query(f"WITH {_PATHS} SELECT seed_id, relation, chunk_id, via, position FROM paths")
def expand_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return g.neighbours(g.seeds)


@query(f"WITH {_REQUESTED} SELECT query_id, chunk_id, score, rank, n_paths, first_seed, path FROM granked")
def graph_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each request's seeds by weight, with the first seed and the first ways to them."""
    return Graph(spark, sf_dir).ranked


_STEP = """,
met_{n} AS (SELECT query_id, p.chunk_id, round(max(f.weight * {weight}), 6) AS weight FROM front_{b} f JOIN paths_{b} p ON p.seed_id = f.chunk_id GROUP BY 1, 2),
front_{n} AS MATERIALIZED (SELECT query_id, chunk_id, {n} AS level, weight FROM met_{n} m WHERE NOT EXISTS (SELECT 1 FROM ({before}) b WHERE b.query_id = m.query_id AND b.chunk_id = m.chunk_id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, chunk_id) <= 10)"""
_WALK = _SEEDS + ", front_0 AS (SELECT query_id, seed_id AS chunk_id, 0 AS level, weight FROM seeds)"
for _n in (1, 2):
    _WALK += f", asks_{_n - 1} AS (SELECT DISTINCT chunk_id AS seed_id FROM front_{_n - 1})" + _expansion(f"paths_{_n - 1}", f"asks_{_n - 1}", gr.PER_RELATION)
    _WALK += _STEP.format(n=_n, b=_n - 1, weight=_WEIGHT, before=" UNION ALL ".join(f"SELECT query_id, chunk_id FROM front_{i}" for i in range(_n)))


@query(f"WITH {_WALK} SELECT * FROM front_0 UNION ALL SELECT * FROM front_1 UNION ALL SELECT * FROM front_2")
def graph_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels from the retrieved seeds, weights multiplied along the way."""
    g = Graph(spark, sf_dir)
    return gr.traverse(g.seeds, g.neighbours, keep=stored)


@query(
    f"""WITH {_PATHS}, one AS (SELECT seed_id, chunk_id, array_to_string(list_sort(list(DISTINCT relation)), ',') AS relations FROM paths WHERE relation IN ('SAME_SECTION', 'ADJACENT', 'SAME_PAGE') GROUP BY 1, 2)
    SELECT seed_id, chunk_id, relations, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY chunk_id) AS INT) AS position FROM one QUALIFY position <= 15"""
)
def graph_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return gr.neighbourhood(g.neighbours(g.seeds))


@query(
    f"""WITH {_FUSED} SELECT query_id, chunk_id, max(CASE WHEN channel = 'fulltext' THEN score END) AS fulltext_score, max(CASE WHEN channel = 'coverage' THEN score END) AS coverage_score, max(CASE WHEN channel = 'graph' THEN score END) AS graph_score,
    max(CASE WHEN channel = 'fulltext' THEN rank END) AS fulltext_rank, max(CASE WHEN channel = 'coverage' THEN rank END) AS coverage_rank, max(CASE WHEN channel = 'graph' THEN rank END) AS graph_rank,
    round(sum(part), 8) AS rrf_score, string_agg(channel || '=' || CAST(CAST(round(round(part, 8) * 100000000) AS BIGINT) AS VARCHAR), ',' ORDER BY channel) AS contributions, arg_max(channel, row(part, channel)) AS best_channel FROM parts3 GROUP BY 1, 2"""
)
def chunk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the lexical, the coverage and the graph channel merged by chunk."""
    rows = rt.merge_candidates(Graph(spark, sf_dir).all_channels, "chunk_id")
    return rows.withColumn("contributions", rt.told(F.col("contributions")))


@query(f"WITH {_FUSED} SELECT query_id, chunk_id, logit, final_rank FROM evidence3")
def chunk_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(spark, sf_dir).evidence.select("query_id", "chunk_id", "logit", "final_rank")


@query(
    f"""WITH {_TRACED} SELECT query_id, seed_id, relation, chunk_id, via, position, reason, CASE WHEN reason = 'METADATA_FILTER_MISMATCH' THEN detail END AS detail, contribution, reason = 'SELECTED_GRAPH_CANDIDATE' AS accepted FROM traced"""
)
def trace_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path up to the safety limit with the first reason that applies, those outside the request's scope or beyond a relation's limit included."""
    return Graph(spark, sf_dir).traced.drop("seq", "is_chosen")


@query(f"WITH {_TRACED} SELECT query_id, seed_id, relation, chunk_id, via, reason FROM traced WHERE is_primary")
def trace_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Graph(spark, sf_dir).traced.where(~F.col("seq.diagnostic"))
    return rows.select("query_id", "seed_id", "relation", "chunk_id", "via", "reason")


@query(f"WITH {_TRACED} SELECT relation, reason, count(*) AS n_paths, count(DISTINCT chunk_id) AS n_chunks FROM traced GROUP BY 1, 2")
def trace_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(spark, sf_dir).traced.groupBy("relation", "reason").agg(F.count("*").alias("n_paths"), F.countDistinct("chunk_id").alias("n_chunks"))


_VIA = "CASE WHEN relation = 'SHARED_CONCEPT' THEN 'concept:' || via ELSE via END"
_STATUS = "CASE WHEN is_chosen AND reason <> 'METADATA_FILTER_MISMATCH' THEN 'accepted' ELSE 'ignored' END"


@query(
    f"""WITH {_TRACED},
    seen AS (SELECT query_id, seed_id AS node_id, 'Chunk' AS label, 'seed' AS kind, 'seed' AS status, row(0, 0, 0) AS seen_at, NULL AS reason, weight AS seed_weight, NULL AS mention_count, NULL AS via_for, NULL AS visual FROM seeds
      UNION ALL SELECT query_id, 'concept:' || concept, 'Concept', 'hub', 'ignored', row(1, 0, 0), 'HUB_CONCEPT_EXCLUDED', NULL, mention_count, NULL, NULL FROM hub_rows
      UNION ALL SELECT query_id, chunk_id, 'Chunk', 'candidate', {_STATUS}, row(2, seq, 0), reason, NULL, NULL, NULL, CASE WHEN reason = 'METADATA_FILTER_MISMATCH' THEN 'metadata_mismatch' ELSE {_STATUS} END FROM traced
      UNION ALL SELECT query_id, {_VIA}, CASE WHEN relation = 'SHARED_CONCEPT' THEN 'Concept' ELSE 'Page' END, 'context', 'context', row(2, seq, 1), NULL, NULL, NULL, relation, NULL FROM traced WHERE via IS NOT NULL),
    why AS (SELECT query_id, node_id, array_to_string(list(reason ORDER BY seen_at), ',') AS reasons, CAST(sum(n) AS BIGINT) AS n_told FROM (SELECT query_id, node_id, reason, min(seen_at) AS seen_at, count(*) AS n FROM seen WHERE reason IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
    node AS (SELECT query_id, node_id, min(seen_at) AS seen_at, arg_min(label, seen_at) AS label, arg_min(kind, seen_at) AS kind, CASE WHEN bool_or(status = 'accepted') THEN 'accepted' ELSE arg_min(status, seen_at) END AS status,
      max(seed_weight) AS seed_weight, max(mention_count) AS mention_count, arg_max(via_for, seen_at) FILTER (WHERE via_for IS NOT NULL) AS via_for, arg_max(visual, seen_at) FILTER (WHERE visual IS NOT NULL) AS visual FROM seen GROUP BY 1, 2
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY min(seen_at), node_id) <= 1000)
    SELECT query_id, node_id, label, kind, CASE WHEN e.chunk_id IS NOT NULL AND kind IN ('seed', 'candidate') THEN 'evidence' ELSE status END AS status, coalesce(reasons, '') AS reasons, coalesce(n_told, 0) AS n_told, seed_weight, g.score AS graph_score,
      mention_count, via_for, CASE WHEN e.chunk_id IS NOT NULL AND kind IN ('seed', 'candidate') THEN 'evidence' ELSE visual END AS visual, f.chunk_id IS NOT NULL AS entered_fusion, e.chunk_id IS NOT NULL AS final_evidence
    FROM node LEFT JOIN why USING (query_id, node_id) LEFT JOIN granked g ON g.query_id = node.query_id AND g.chunk_id = node_id LEFT JOIN fused3 f ON f.query_id = node.query_id AND f.chunk_id = node_id
    LEFT JOIN evidence3 e ON e.query_id = node.query_id AND e.chunk_id = node_id"""
)
def trace_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return gr.trace_nodes(g.traced, g.seeds, g.hub_rows, g.ranked, g.fused, g.evidence)


_PHYSICAL = "CASE relation " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in gr.STORED_AS.items()) + " END"


@query(
    f"""WITH {_TRACED}, e AS (
      SELECT query_id, seed_id AS source, chunk_id AS target, relation, relation <> 'SAME_LESSON' AS physical, reason = 'SELECTED_GRAPH_CANDIDATE' AS accepted FROM traced WHERE via IS NULL
      UNION ALL SELECT query_id, seed_id, {_VIA}, {_PHYSICAL}, true, reason = 'SELECTED_GRAPH_CANDIDATE' FROM traced WHERE via IS NOT NULL
      UNION ALL SELECT query_id, {_VIA}, chunk_id, {_PHYSICAL}, true, reason = 'SELECTED_GRAPH_CANDIDATE' FROM traced WHERE via IS NOT NULL
      UNION ALL SELECT query_id, seed_id, 'concept:' || concept, 'MENTIONS', true, false FROM hub_rows)
    SELECT query_id, source, target, relation, physical, bool_or(accepted) AS accepted, count(*) AS n_paths FROM e GROUP BY 1, 2, 3, 4, 5"""
)
def trace_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return gr.trace_edges(g.traced, g.hub_rows)


@query(f"WITH {_TRACED} SELECT query_id, concept, any_value(mention_count) AS mention_count, count(*) AS n_seeds FROM hub_rows GROUP BY 1, 2")
def trace_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hub concepts that a request's seeds mention and that no path goes through."""
    return Graph(spark, sf_dir).hub_rows.groupBy("query_id", "concept").agg(F.first("mention_count").alias("mention_count"), F.count("*").alias("n_seeds"))
