"""Queries of the inspection tools over the whole graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import inspection as ins
from marlstone.plans import queries as q
from marlstone.plans.graph_queries import Graph
from marlstone.plans.queries import query
from marlstone.sources import corpus

_ON_PAGE = "pages_of AS (SELECT chunk_id, document_id, document_id || printf(':p%04d', p) AS page_id FROM (SELECT chunk_id, document_id, unnest(range(page_start, page_end + 1)) AS p FROM chunks))"


@query(
    f"""WITH {q._CHUNKS}, {_ON_PAGE}, every AS (
      SELECT a.chunk_id, 'SAME_SECTION' AS relation, b.chunk_id AS neighbour_id FROM chunks a JOIN chunks b USING (section_id) WHERE a.chunk_id <> b.chunk_id
      UNION SELECT a.chunk_id, 'ADJACENT', b.chunk_id FROM chunks a JOIN chunks b USING (document_id) WHERE abs(a.chunk_index - b.chunk_index) = 1
      UNION SELECT a.chunk_id, 'SAME_PAGE', b.chunk_id FROM pages_of a JOIN pages_of b USING (page_id) WHERE a.chunk_id <> b.chunk_id)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY relation, neighbour_id) AS INT) AS position FROM every) WHERE position <= {ins.MOST}"""
)
def chunk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graph(spark, sf_dir)
    return ins.neighbours(graph.chunks, corpus.on_page(graph.chunks))


@query(
    f"""WITH {q._VOCAB}, seen AS (SELECT concept, count(*) AS corpus_mentions FROM mentions GROUP BY 1),
    placed AS (SELECT chunk_id, concept, occurrences, corpus_mentions, row_number() OVER (PARTITION BY chunk_id ORDER BY occurrences DESC, concept) AS position FROM mentions JOIN seen USING (concept)),
    told AS (SELECT chunk_id, string_agg(concept || ' ' || occurrences || '/' || corpus_mentions, '; ' ORDER BY position) AS concepts FROM placed WHERE position <= {ins.MOST} GROUP BY 1)
    SELECT a.chunk_id, a.grade, a.subject, a.unit_id, a.section_title, b.chunk_id AS previous_id, c.chunk_id AS next_id, concepts FROM chunks a LEFT JOIN chunks b ON a.document_id = b.document_id AND b.chunk_index = a.chunk_index - 1
    LEFT JOIN chunks c ON a.document_id = c.document_id AND c.chunk_index = a.chunk_index + 1 LEFT JOIN told t ON a.chunk_id = t.chunk_id"""
)
def chunk_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk with its lineage, its place in reading order and its concepts."""
    graph = Graph(spark, sf_dir)
    each = F.struct("position", F.concat("concept", F.lit(" "), "occurrences", F.lit("/"), "corpus_mentions").alias("s"))
    told = ins.concepts_of(graph.mentions).groupBy("chunk_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["s"]), "; ").alias("concepts"))
    rows = graph.chunks.select("chunk_id", "grade", "subject", "unit_id", "section_title")
    return rows.join(ins.reading_order(graph.chunks), "chunk_id").join(told, "chunk_id", "left")


@query(
    f"""WITH {q._VOCAB}, sec AS (SELECT unit_id, section_id AS name, count(*) AS n FROM chunks GROUP BY 1, 2), con AS (SELECT unit_id, concept AS name, count(*) AS n FROM mentions JOIN chunks USING (chunk_id) GROUP BY 1, 2)
    SELECT unit_id, 'document' AS kind, document_id AS name, count(*) AS n, CAST(NULL AS INT) AS position FROM chunks GROUP BY 1, 3
    UNION ALL SELECT * FROM (SELECT unit_id, 'section', name, n, CAST(row_number() OVER (PARTITION BY unit_id ORDER BY name) AS INT) AS p FROM sec) WHERE p <= {ins.MOST}
    UNION ALL SELECT * FROM (SELECT unit_id, 'concept', name, n, CAST(row_number() OVER (PARTITION BY unit_id ORDER BY n DESC, name) AS INT) AS p FROM con) WHERE p <= {ins.MOST}"""
)
def unit_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graph(spark, sf_dir)
    return ins.contents(graph.chunks, graph.mentions)


@query(
    f"""WITH {q._VOCAB}, {_ON_PAGE}, n AS (
      SELECT 'node' AS kind, 'grade' AS label, count(DISTINCT grade) AS n FROM chunks UNION ALL SELECT 'node', 'subject', count(DISTINCT (grade, subject)) FROM chunks UNION ALL SELECT 'node', 'unit', count(DISTINCT unit_id) FROM chunks
      UNION ALL SELECT 'node', 'document', count(DISTINCT document_id) FROM chunks UNION ALL SELECT 'node', 'section', count(DISTINCT section_id) FROM chunks UNION ALL SELECT 'node', 'chunk', count(*) FROM chunks
      UNION ALL SELECT 'node', 'page', count(DISTINCT page_id) FROM pages_of UNION ALL SELECT 'node', 'concept', count(DISTINCT concept) FROM mentions
      UNION ALL SELECT 'edge', 'HAS_SUBJECT', count(*) FROM (SELECT DISTINCT grade, subject FROM chunks) UNION ALL SELECT 'edge', 'HAS_UNIT', count(*) FROM (SELECT DISTINCT grade, subject, unit_id FROM chunks)
      UNION ALL SELECT 'edge', 'HAS_DOCUMENT', count(*) FROM (SELECT DISTINCT unit_id, document_id FROM chunks) UNION ALL SELECT 'edge', 'HAS_SECTION', count(*) FROM (SELECT DISTINCT document_id, section_id FROM chunks)
      UNION ALL SELECT 'edge', 'HAS_CHUNK', count(*) FROM (SELECT DISTINCT section_id, chunk_id FROM chunks) UNION ALL SELECT 'edge', 'HAS_PAGE', count(*) FROM (SELECT DISTINCT document_id, page_id FROM pages_of)
      UNION ALL SELECT 'edge', 'ON_PAGE', count(*) FROM pages_of UNION ALL SELECT 'edge', 'MENTIONS', count(*) FROM mentions
      UNION ALL SELECT 'edge', 'NEXT', count(*) FROM chunks a JOIN chunks b ON a.document_id = b.document_id AND b.chunk_index = a.chunk_index + 1)
    SELECT kind, label, n FROM n UNION ALL SELECT kind, 'all', CAST(sum(n) AS BIGINT) FROM n GROUP BY 1"""
)
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graph(spark, sf_dir)
    return ins.counts(graph.chunks, corpus.on_page(graph.chunks), graph.mentions)
