"""All queries on the given tables by name, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import answers as an
from marlstone.functions import concepts as cn
from marlstone.functions import model_json as mj
from marlstone.functions import partitions as rules
from marlstone.functions import text as tx
from marlstone.functions.scope import Scope
from marlstone.operators import chunking as ck
from marlstone.operators import phrases as ph
from marlstone.operators import retrieval as rt
from marlstone.operators import vectors as vs
from marlstone.session import spread, stored, table
from marlstone.sources import corpus
from marlstone.streaming import events as ev

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_''’]+')"


def _terms(tok: str) -> str:
    kept = f"list_filter(list_distinct({tok}), lambda t: length(t) > 1 AND NOT list_contains([{_STOP}], t))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE list_filter(list_distinct({tok}), lambda t: length(t) > 1) END"


_CONTENT = f"list_filter(list_distinct({_TOK}), lambda t: length(t) > 2 AND NOT list_contains([{_STOP}], t))"
_LINEAGE = """
lineage AS (
  SELECT *, unit_id || ':student:' || printf('doc%06d', doc_id) AS document_id,
         CASE WHEN doc_id % 7 = 0 THEN 'support' ELSE 'primary' END AS source_role
  FROM (SELECT *, printf('grade_%02d', grade) || ':' || subject || ':' || source AS unit_id FROM (
    SELECT *, CASE WHEN grade <= 2 THEN 'mathematics' WHEN grade <= 10 THEN ['mathematics', 'science'][CAST((doc_id // 12) % 2 + 1 AS INT)]
                   ELSE ['mathematics', 'physics', 'chemistry', 'biology'][CAST((doc_id // 12) % 4 + 1 AS INT)] END AS subject
    FROM (SELECT doc_id, text, source, lang, CAST(1 + doc_id % 12 AS INT) AS grade FROM documents))))"""
_CHUNKS = (
    _LINEAGE
    + """,
lined AS (SELECT *, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS l FROM lineage),
cut AS (SELECT *, unnest(range(0, (len(l) + 3) // 4)) AS i FROM lined WHERE len(l) > 0),
chunks AS (
  SELECT document_id || printf(':c%04d', i) AS chunk_id, doc_id, document_id, unit_id, grade, subject, source, lang, source_role, CAST(i AS INT) AS chunk_index,
         document_id || printf(':s%04d', (i * 4) // 10) AS section_id, substring(l[CAST((i * 4) // 10 * 10 + 1 AS INT)], 1, 60) AS section_title,
         CAST(1 + (i * 4) // 5 AS INT) AS page_start, CAST(1 + (i * 4 + least(4, len(l) - i * 4) - 1) // 5 AS INT) AS page_end,
         array_to_string(list_slice(l, i * 4 + 1, i * 4 + 4), chr(10)) AS text
  FROM cut)"""
)


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"
_URLS, _HITS = (f"len(regexp_extract_all(text, '{_q(p)}'))" for p in (rules.URL, rules.BOILERPLATE_BODY))
_BOILER = (
    f"(regexp_matches(substring(text, 1, 120), '{_q(rules.BOILERPLATE_HEADING)}') OR ({_URLS} >= 3 AND {_URLS} > {_WORDS} * 0.04) "
    f"OR (regexp_matches(text, '{_q(rules.FOOTER)}') AND length(text) < 900) OR ({_HITS} > 0 AND (length(text) < 700 OR {_HITS} >= 2 OR {_WORDS} < 80)))"
)
_CLASSIFIED = (
    _CHUNKS
    + f""",
prior AS (SELECT *, lag(section_title) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS before FROM chunks),
classified AS (
  SELECT *, CASE WHEN {_BOILER} THEN 'excluded_boilerplate'
    WHEN regexp_matches(trim(section_title), '{_q(rules.EVALUATION_HEADING)}') THEN 'evaluation_only'
    WHEN regexp_matches(substring(text, 1, 1500), '{_q(rules.SOLUTION_BODY)}') THEN 'evaluation_only'
    WHEN regexp_matches(coalesce(before, ''), '(?i)answer\\s*key') THEN 'evaluation_only'
    WHEN regexp_matches(trim(section_title), '{_q(rules.STRATEGY_HEADING)}') THEN 'teacher_strategy'
    WHEN regexp_matches(trim(section_title), '{_q(rules.PRACTICE_HEADING)}') THEN 'practice_only'
    WHEN regexp_matches(trim(section_title), '{_q(rules.BOILERPLATE_HEADING)}') THEN 'excluded_boilerplate'
    ELSE 'student_evidence' END AS content_partition
  FROM prior)"""
)
_SAFE = "content_partition IN ('student_evidence', 'teacher_strategy')"


# -- scope, identifiers, text -------------------------------------------------------------------------------------


@query(f"WITH {_CLASSIFIED} SELECT chunk_id, grade, subject, content_partition FROM classified WHERE grade = 5 AND subject = 'science' AND {_SAFE}")
def scope_filter_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.classified(spark, sf_dir).where(Scope(grade=5, subject="science").validate().predicate())
    return rows.select("chunk_id", "grade", "subject", "content_partition")


@query(f"WITH {_CLASSIFIED} SELECT chunk_id, grade, subject, content_partition FROM classified WHERE grade <= 11 AND subject IN ('physics', 'science') AND {_SAFE}")
def scope_filter_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.classified(spark, sf_dir).where(Scope(grade=11, subject="physics", look_back=True).validate().predicate())
    return rows.select("chunk_id", "grade", "subject", "content_partition")


@query(f"WITH {_LINEAGE} SELECT doc_id, grade, subject, unit_id, document_id, source_role FROM lineage")
def hierarchy_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.with_lineage(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return docs.select("doc_id", "grade", "subject", "unit_id", "document_id", "source_role")


@query(
    f"""WITH {_CHUNKS} SELECT chunk_id, regexp_replace(regexp_replace(lower(regexp_replace(translate(section_title, '{tx.ACCENTS}', '{tx.PLAIN}'),
    '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM chunks"""
)
def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunks(spark, sf_dir).select("chunk_id", tx.slug(F.col("section_title")).alias("slug"))


@query(f"SELECT doc_id, greatest(1, CAST(round_even({_WORDS} * 1.35::DOUBLE, 0) AS INT)) AS n_tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_count(F.col("text")).alias("n_tokens"))


@query(
    r"""SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+(["''(\[]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)),
    lambda x: trim(x) <> '')) AS n_sentences FROM documents"""
)
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query(f"SELECT item_id, array_to_string(list_sort({_terms(_TOK)}), ' ') AS terms FROM benchmark")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.sort_array(tx.query_terms(F.col("text"))), " ").alias("terms"))


@query(f"SELECT doc_id, len({_TOK}) AS n_tokens, len({_CONTENT}) AS n_content FROM documents")
def content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.tokens(text)).cast("long").alias("n_tokens"), F.size(tx.content_terms(text)).cast("long").alias("n_content"))


@query("SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t\u00a0]+', ' ', 'g')) AS line FROM conversations")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.clean_line(F.col("text")).alias("line"))


@query(f"SELECT conv_id, turn, regexp_matches(text, '{_q(tx.FIGURE_CUES)}') AS needs_figure FROM conversations")
def figure_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_like("text", F.lit(tx.FIGURE_CUES)).alias("needs_figure"))


@query(
    rf"""SELECT doc_id, regexp_replace(regexp_replace(text, '{tx.SECRETS}(\s*[=:]\s*)\S+', '\1\2[redacted]', 'g'), '{tx.SECRETS}', '[redacted]', 'g') AS text FROM documents"""
)
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.redact_secrets(F.col("text")).alias("text"))


@query("SELECT event_id, try_cast(props AS JSON) IS NOT NULL AS parsed FROM events")
def rewrite_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").isNotNull().alias("parsed"))


_REWRITTEN = r"""
said AS (SELECT conv_id, turn, coalesce(text, '') AS text, (conv_id + turn) % 5 AS shape, to_json({'retrieval_query': CASE WHEN (conv_id + turn) % 3 = 0 THEN ' ' ELSE text END, 'intent': role, 'input_kind': 'Diagram'})::VARCHAR AS j FROM conversations),
raw AS (SELECT *, trim(CASE shape WHEN 0 THEN j WHEN 1 THEN '```json' || chr(10) || j || chr(10) || '```' WHEN 2 THEN 'Here it is: ' || j || ' Done.' WHEN 3 THEN text ELSE '{"retrieval_query": ' || text || '}' END) AS r FROM said),
bare AS (SELECT *, CASE WHEN starts_with(r, '```') THEN regexp_replace(regexp_replace(r, '^```(?:json)?\s*', ''), '\s*```$', '') ELSE r END AS b FROM raw),
obj AS (SELECT *, nullif(regexp_extract(b, '(?s)\{.*\}'), '') AS o FROM bare),
parsed AS (SELECT *, TRY_CAST(o AS JSON) AS p FROM obj),
got AS (SELECT *, CASE WHEN json_type(p, '$.retrieval_query') = 'VARCHAR' THEN trim(regexp_replace(json_extract_string(p, '$.retrieval_query'), '\s+', ' ', 'g')) END AS q,
  lower(CASE WHEN json_type(p, '$.intent') = 'VARCHAR' THEN json_extract_string(p, '$.intent') END) AS i, lower(CASE WHEN json_type(p, '$.input_kind') = 'VARCHAR' THEN json_extract_string(p, '$.input_kind') END) AS k FROM parsed),
judged AS (SELECT *, CASE WHEN o IS NULL THEN 'rewriter output was not JSON' WHEN p IS NULL THEN 'rewriter JSON could not be parsed' WHEN coalesce(q, '') = '' THEN 'retrieval_query missing' END AS reason FROM got)"""


@query(
    f"""WITH {_REWRITTEN.strip()} SELECT conv_id, turn, CASE WHEN reason IS NULL THEN q WHEN reason = 'retrieval_query missing' AND trim(text) <> '' THEN trim(text) ELSE text END AS retrieval_query,
    CASE WHEN reason IS NULL AND i IN ('explain', 'verify', 'practice') THEN i ELSE 'other' END AS intent, CASE WHEN k IN ('math_problem', 'diagram') THEN k ELSE 'other' END AS input_kind, reason IS NOT NULL AS fallback, reason FROM judged"""
)
def rewrite_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewriter outputs of several shapes, made of each turn: plain, fenced and surrounded objects, no object, and one that is no JSON."""
    t, at = F.coalesce("text", F.lit("")), F.col("conv_id") + F.col("turn")
    made = F.to_json(F.struct(F.when(at % 3 == 0, " ").otherwise(F.col("text")).alias("retrieval_query"), F.col("role").alias("intent"), F.lit("Diagram").alias("input_kind")))
    raw = (
        F.when(at % 5 == 0, made).when(at % 5 == 1, F.concat(F.lit("```json\n"), made, F.lit("\n```"))).when(at % 5 == 2, F.concat(F.lit("Here it is: "), made, F.lit(" Done."))).when(at % 5 == 3, t)
        .otherwise(F.concat(F.lit('{"retrieval_query": '), t, F.lit("}")))
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw"), t.alias("original"))
    return mj.rewrite(rows).drop("transcribed_question")


# -- documents, pages, classification -----------------------------------------------------------------------------


_PLAIN = "regexp_replace({}, '<[^>]*>', '', 'g')"
for _entity, _character in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_entity}', '{_character}')"
_BLOCK = "h1|h2|h3|h4|p|li|caption|figcaption"
_BLOCKS = rf"""
bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<(?:script|style)[^>]*>.*?</(?:script|style)>', '', 'g'), '(?s)<nav[^>]*>.*?</nav>', '</li>', 'g') AS h FROM pages),
marked AS (SELECT page_id, string_split(regexp_replace(regexp_replace(h, '<({_BLOCK})(?: [^>]*)?>', chr(1) || '\1' || chr(2), 'g'), '</(?:{_BLOCK})>', chr(1) || 'p' || chr(2), 'g'), chr(1)) AS f FROM bare),
piece AS (SELECT page_id, i, CASE WHEN i = 1 THEN 'p' ELSE string_split(f[i], chr(2))[1] END AS tag, CASE WHEN i = 1 THEN f[i] ELSE string_split(f[i], chr(2))[2] END AS raw
  FROM (SELECT page_id, f, unnest(generate_series(1, len(f))) AS i FROM marked)),
filled AS (SELECT page_id, i, tag, trim(regexp_replace({_PLAIN.format("raw")}, '\s+', ' ', 'g')) AS text FROM piece),
blocks AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS position, tag, text FROM filled WHERE text <> '')"""


@query(f"WITH {_BLOCKS} SELECT page_id, position, tag, text FROM blocks")
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.html_blocks(spark, sf_dir)


@query(
    f"""WITH {_BLOCKS},
    s AS (SELECT *, sum(CASE WHEN tag IN ('h1', 'h2', 'h3') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY position) AS section FROM blocks)
    SELECT page_id, CAST(section AS BIGINT) AS section, min(CASE WHEN tag IN ('h1', 'h2', 'h3') THEN text END) AS title,
    CAST(sum(CASE WHEN tag IN ('h1', 'h2', 'h3') THEN 0 ELSE 1 END) AS BIGINT) AS n_paragraphs FROM s GROUP BY page_id, section"""
)
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.col("tag").isin("h1", "h2", "h3")
    number = F.sum(heading.cast("long")).over(Window.partitionBy("page_id").orderBy("position"))
    rows = corpus.html_blocks(spark, sf_dir).withColumn("section", number)
    return rows.groupBy("page_id", "section").agg(F.min(F.when(heading, F.col("text"))).alias("title"), F.sum((~heading).cast("long")).alias("n_paragraphs"))


@query(
    f"""WITH {_CHUNKS} SELECT doc_id, CAST(i AS INT) AS paragraph_index, CAST(1 + i // 5 AS INT) AS page_number, CAST(i // 10 AS INT) AS section_index, length(l[CAST(i + 1 AS INT)]) AS n_chars
    FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM lined WHERE len(l) > 0)"""
)
def paragraph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.lines(F.col("text"))).alias("i", "x"))
    cut = lambda n: F.floor(F.col("i") / n).cast("int")
    return rows.select("doc_id", F.col("i").alias("paragraph_index"), (1 + cut(5)).alias("page_number"), cut(10).alias("section_index"), F.length("x").cast("long").alias("n_chars"))


@query(f"WITH {_CHUNKS} SELECT chunk_id, section_id, section_title, page_start, page_end, length(text) AS n_chars FROM chunks")
def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunks(spark, sf_dir).select("chunk_id", "section_id", "section_title", "page_start", "page_end", F.length("text").cast("long").alias("n_chars"))


@query(
    f"""WITH {_CHUNKS} SELECT document_id || printf(':p%04d', p) AS page_id, count(*) AS n_chunks
    FROM (SELECT document_id, unnest(range(page_start, page_end + 1)) AS p FROM chunks) GROUP BY 1"""
)
def page_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.on_page(corpus.chunks(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("n_chunks"))


@query(
    f"""WITH {_CHUNKS}, n AS (SELECT document_id, greatest(1, CAST(round_even({_WORDS} * 1.35::DOUBLE, 0) AS INT)) AS t FROM chunks)
    SELECT document_id, count(*) AS n_chunks, min(t) AS min_tokens, round(avg(t), 4) AS mean_tokens, max(t) AS max_tokens FROM n GROUP BY 1"""
)
def chunk_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.chunks(spark, sf_dir).select("document_id", tx.token_count(F.col("text")).alias("t"))
    return rows.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.min("t").alias("min_tokens"), F.round(F.avg("t"), 4).alias("mean_tokens"), F.max("t").alias("max_tokens"))


@query(f"WITH {_CLASSIFIED} SELECT chunk_id, content_partition FROM classified")
def classify_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.classified(spark, sf_dir).select("chunk_id", "content_partition")


@query(f"SELECT doc_id, {_BOILER} AS boilerplate FROM documents")
def boilerplate_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", rules.boilerplate(F.col("text")).alias("boilerplate"))


@query(f"WITH {_CLASSIFIED} SELECT source, content_partition, count(*) AS n_chunks FROM classified GROUP BY 1, 2")
def partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.classified(spark, sf_dir).groupBy("source", "content_partition").agg(F.count("*").alias("n_chunks"))


@query(
    "SELECT conv_id, turn, lead(turn) OVER w AS next_turn, lag(turn) OVER w AS previous_turn, lag(role) OVER w AS previous_role "
    "FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"
)
def next_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.lead("turn").over(w).alias("next_turn"), F.lag("turn").over(w).alias("previous_turn"), F.lag("role").over(w).alias("previous_role")
    )


@query(f"WITH {_CLASSIFIED} SELECT chunk_id, section_title, before AS previous_title FROM classified")
def prev_title_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("section_title").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    return corpus.chunks(spark, sf_dir).select("chunk_id", "section_title", before.alias("previous_title"))


# -- concepts -----------------------------------------------------------------------------------------------------

_VOCAB = (
    _CHUNKS
    + rf""",
title_terms AS (SELECT DISTINCT section_title, unnest(regexp_extract_all(lower(section_title), '[\p{{L}}]{{5,}}')) AS concept FROM chunks),
vocabulary AS (SELECT concept, count(DISTINCT section_title) AS support FROM title_terms WHERE NOT list_contains([{_STOP}], concept) GROUP BY 1 HAVING count(DISTINCT section_title) >= 2),
mentions AS (SELECT chunk_id, concept, count(*) AS occurrences FROM (SELECT chunk_id, unnest({_TOK}) AS concept FROM chunks) JOIN vocabulary USING (concept) GROUP BY 1, 2)"""
)


def _vocabulary(chunk_rows: DataFrame) -> DataFrame:
    found = F.regexp_extract_all(F.lower("section_title"), F.lit(r"[\p{L}]{5,}"), F.lit(0))
    terms = chunk_rows.select("section_title", F.explode(found).alias("concept")).where(~F.col("concept").isin(*tx.STOP_WORDS))
    return terms.groupBy("concept").agg(F.countDistinct("section_title").alias("support")).where(F.col("support") >= 2)


def _mentions(chunk_rows: DataFrame) -> DataFrame:
    each = chunk_rows.select("chunk_id", F.explode(tx.tokens(F.col("text"))).alias("concept"))
    return each.join(_vocabulary(chunk_rows).select("concept"), "concept").groupBy("chunk_id", "concept").agg(F.count("*").alias("occurrences"))


@query(f"WITH {_VOCAB} SELECT concept, support FROM vocabulary")
def concept_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(corpus.chunks(spark, sf_dir))


@query(f"WITH {_VOCAB} SELECT concept, count(DISTINCT chunk_id) AS mention_count FROM mentions GROUP BY 1")
def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(corpus.chunks(spark, sf_dir)).groupBy("concept").agg(F.count("*").alias("mention_count"))


@query(f"WITH {_VOCAB} SELECT concept, count(DISTINCT chunk_id) AS mention_count FROM mentions GROUP BY 1 HAVING count(DISTINCT chunk_id) > 400")
def hub_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mention_counts(spark, sf_dir).where(F.col("mention_count") > 400)


@query(
    f"""WITH {_VOCAB}, r AS (SELECT chunk_id, concept, occurrences, row_number() OVER (PARTITION BY chunk_id ORDER BY length(concept) DESC, occurrences DESC, concept) AS rank FROM mentions)
    SELECT chunk_id, concept, occurrences, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8"""
)
def concept_mentions_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("chunk_id").orderBy(F.desc(F.length("concept")), F.desc("occurrences"), "concept")
    return _mentions(corpus.chunks(spark, sf_dir)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 8)


# -- retrieval ----------------------------------------------------------------------------------------------------

_COS = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"


def _dense_sql(where: str) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q WHERE {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors, vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(_dense_sql("true"))
def dense_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vs.exact(*_vectors(spark, sf_dir))


@query(_dense_sql("e.label = 3"))
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, wanted = _vectors(spark, sf_dir)
    return vs.exact(vectors.where(F.col("label") == 3), wanted)


#: Share of the lists that are probed; the given vectors lie in all directions alike, so it is large. The tests measure its recall.
PROBED = 0.65


@query()
def dense_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate search in the nearest lists of an inverted-file index."""
    vectors, wanted = _vectors(spark, sf_dir)
    index = vs.build(vectors)
    return vs.search(index, wanted, n_probes=max(1, round(PROBED * len(index.centroids))))


@query(_dense_sql("true"))
def dense_index_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, wanted = _vectors(spark, sf_dir)
    return vs.search(vs.build(vectors), wanted)


@query(
    f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, {_COS} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS near FROM s),
    c AS (SELECT *, count_if(near <= 160) OVER (PARTITION BY query_id) AS got FROM n WHERE label IN (3, 7)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM c)
    SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank, CASE WHEN got >= 20 THEN 'index' ELSE 'exact' END AS strategy FROM r WHERE rank <= 20"""
)
def dense_index_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversampled candidates of the index, filtered by label; queries that they don't fill are searched exactly."""
    vectors, wanted = _vectors(spark, sf_dir)
    return vs.filtered(vs.build(vectors), vectors, wanted, F.col("label").isin(3, 7))


_LEXICAL = rf"""
wanted AS (SELECT item_id AS query_id, unnest({_terms(_TOK)}) AS term FROM benchmark),
toks AS (SELECT doc_id, {_TOK} AS t FROM documents),
sizes AS (SELECT doc_id, len(t) AS len FROM toks),
stats AS (SELECT count(*) AS docs, avg(len) AS mean FROM sizes),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM wanted) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score
  FROM tf JOIN df USING (term) JOIN sizes USING (doc_id) JOIN wanted USING (term), stats GROUP BY 1, 2),
lexical AS (SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 20),
qn AS (SELECT query_id, count(*) AS n FROM wanted GROUP BY 1),
cv AS (SELECT query_id, doc_id, round(count(*) / any_value(n), 6) AS score FROM tf JOIN wanted USING (term) JOIN qn USING (query_id) GROUP BY 1, 2),
covering AS (SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cv) WHERE rank <= 20),
parts AS (SELECT query_id, doc_id, 'fulltext' AS channel, rank, 1.0 / (60 + rank) AS part FROM lexical UNION ALL SELECT query_id, doc_id, 'coverage', rank, 0.5 / (60 + rank) FROM covering),
fsum AS (SELECT query_id, doc_id, round(sum(part), 8) AS rrf_score, max(CASE WHEN channel = 'fulltext' THEN rank END) AS fulltext_rank, max(CASE WHEN channel = 'coverage' THEN rank END) AS coverage_rank FROM parts GROUP BY 1, 2),
fused AS (SELECT query_id, doc_id, rrf_score, fulltext_rank, coverage_rank, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS rank FROM fsum) WHERE rank <= 20),
qc AS (SELECT item_id AS query_id, {_CONTENT} AS q FROM benchmark),
logits AS (SELECT f.*, round(6 * CASE WHEN len(q) > 0 THEN len(list_intersect(q, list_distinct(t))) / len(q) ELSE 0 END - 3, 6) AS logit FROM fused f JOIN qc USING (query_id) JOIN toks USING (doc_id)),
reranked AS (SELECT *, round(1 / (1 + exp(-logit)), 6) AS probability, CAST(row_number() OVER (PARTITION BY query_id ORDER BY logit DESC, rank) AS INT) AS rerank FROM logits)"""
_FINAL = (
    _LEXICAL
    + """,
roles AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'support' ELSE 'primary' END AS source_role FROM reranked),
tiers AS (SELECT *, CASE WHEN logit >= 0 AND source_role = 'primary' THEN 1 WHEN logit >= 0 THEN 2 WHEN source_role = 'primary' THEN 3 ELSE 4 END AS tier FROM roles),
placed AS (SELECT *, CASE WHEN tier = 1 THEN 'primary_adequate' WHEN tier = 2 AND min(tier) OVER (PARTITION BY query_id) = 1 THEN 'support_fills_gap' WHEN tier = 2 THEN 'no_adequate_primary' ELSE 'below_score_floor_fill' END AS reason,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, rerank, doc_id) AS INT) AS final_rank FROM tiers),
final AS (SELECT * FROM placed WHERE final_rank <= 5)"""
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.queries_of(table(spark, sf_dir, "benchmark"), "item_id")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {_LEXICAL} SELECT query_id, doc_id, score, rank FROM lexical")
def lexical_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.bm25(_documents(spark, sf_dir), _wanted(spark, sf_dir))


def _channels(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, float]]:
    docs, wanted = _documents(spark, sf_dir), _wanted(spark, sf_dir)
    index = rt.postings(docs, wanted)
    return {"fulltext": (rt.bm25(docs, wanted, index=index), 1.0), "coverage": (rt.coverage(docs, wanted, index=index), 0.5)}


@query(f"WITH {_LEXICAL} SELECT query_id, doc_id, score, rank FROM covering")
def coverage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.coverage(_documents(spark, sf_dir), _wanted(spark, sf_dir))


@query(f"WITH {_LEXICAL} SELECT query_id, doc_id, rrf_score, fulltext_rank, coverage_rank, rank FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.rrf(_channels(spark, sf_dir), "doc_id")


@query(f"WITH {_LEXICAL}, s AS (SELECT doc_id, round(max(1.0 / rank), 6) AS weight FROM (SELECT doc_id, rank FROM lexical UNION ALL SELECT doc_id, rank FROM covering) GROUP BY 1) SELECT doc_id, weight FROM s")
def seeds_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = reduce(DataFrame.unionByName, [c for c, _ in _channels(spark, sf_dir).values()])
    return both.groupBy("doc_id").agg(F.round(F.max(1.0 / F.col("rank")), 6).alias("weight"))


@query(f"WITH {_LEXICAL} SELECT query_id, doc_id, rank, logit, probability, rerank, rank - rerank AS movement FROM reranked")
def rerank_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rt.rerank(rrf_fusion(spark, sf_dir), _documents(spark, sf_dir), _questions(spark, sf_dir))
    return rows.select("query_id", "doc_id", "rank", "logit", "probability", "rerank", "movement")


@query(
    f"""WITH {_LEXICAL}, g AS (SELECT query_id, doc_id, logit, rerank, CAST(1 + query_id % 12 AS INT) AS wanted_grade, CAST(1 + doc_id % 12 AS INT) AS grade FROM reranked)
    SELECT query_id, doc_id, grade, CAST(row_number() OVER (PARTITION BY query_id ORDER BY logit DESC, wanted_grade - grade, rerank) AS INT) AS rank FROM g WHERE grade <= wanted_grade"""
)
def grade_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rerank_movement(spark, sf_dir).withColumns({"wanted": 1 + F.col("query_id") % 12, "grade": (1 + F.col("doc_id") % 12).cast("int")})
    order = Window.partitionBy("query_id").orderBy(F.desc("logit"), F.col("wanted") - F.col("grade"), "rerank")
    return rows.where("grade <= wanted").select("query_id", "doc_id", "grade", F.row_number().over(order).alias("rank"))


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("doc_id") % 7 == 0, "support").otherwise("primary")
    return rt.select_final(rerank_movement(spark, sf_dir).withColumn("source_role", role))


@query(f"WITH {_FINAL} SELECT query_id, doc_id, logit, tier, reason, final_rank FROM final")
def final_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir).select("query_id", "doc_id", "logit", "tier", "reason", "final_rank")


_SCOPED = (
    _FINAL
    + f""",
asked AS (SELECT query_id, grade AS q_grade, subject AS q_subject, CASE WHEN subject = 'mathematics' THEN list_filter(q, lambda x: NOT list_contains([{", ".join(f"'{w}'" for w in tx.OPERATION_WORDS)}], x) AND NOT regexp_matches(x, '{tx.INSTANCE}')) ELSE q END AS q FROM qc JOIN (SELECT doc_id AS query_id, grade, subject FROM (
  SELECT doc_id, CAST(1 + doc_id % 12 AS INT) AS grade, CASE WHEN 1 + doc_id % 12 <= 2 THEN 'mathematics' WHEN 1 + doc_id % 12 <= 10 THEN ['mathematics', 'science'][CAST((doc_id // 12) % 2 + 1 AS INT)]
    ELSE ['mathematics', 'physics', 'chemistry', 'biology'][CAST((doc_id // 12) % 4 + 1 AS INT)] END AS subject FROM (SELECT item_id AS doc_id FROM benchmark))) USING (query_id)),
{_LINEAGE.strip()},
titled AS (SELECT *, coalesce(trim(substring(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')[1], 1, 60)), '') AS title FROM lineage),
seen AS (SELECT f.query_id, f.doc_id, f.logit, f.final_rank, q, list_distinct(t) AS t, NOT {_BOILER} AND NOT regexp_matches(title, '{_q(rules.EVALUATION_HEADING)}') AND NOT regexp_matches(substring(text, 1, 1500), '{_q(rules.SOLUTION_BODY)}')
      AND (regexp_matches(title, '{_q(rules.STRATEGY_HEADING)}') OR NOT (regexp_matches(title, '{_q(rules.PRACTICE_HEADING)}') OR regexp_matches(title, '{_q(rules.BOILERPLATE_HEADING)}'))) AS safe, grade = q_grade AS is_current,
    coalesce(grade <= q_grade AND (subject = q_subject OR (q_subject IN ('physics', 'chemistry', 'biology') AND subject = 'science')), false) AS inside
  FROM final f JOIN asked USING (query_id) JOIN toks USING (doc_id) JOIN titled USING (doc_id)),
best AS (SELECT *, logit >= 0 OR (max(CASE WHEN safe THEN logit END) OVER w < 0 AND row_number() OVER (PARTITION BY query_id, safe ORDER BY inside DESC, logit DESC, final_rank) = 1) AS strong FROM seen WINDOW w AS (PARTITION BY query_id)),
held AS (SELECT *, safe AND strong AS is_strong, safe AND strong AND inside AS scoped, bool_or(safe AND strong AND inside AND is_current) OVER (PARTITION BY query_id) AS any_current FROM best),
kept AS (SELECT *, scoped AND (is_current OR NOT any_current OR logit >= 1) AS keep FROM held),
sums AS (SELECT query_id, count(*) AS n, count(logit) AS n_scored, count_if(safe) AS n_safe, max(CASE WHEN safe THEN logit END) AS top, count_if(is_strong) AS n_strong, count_if(keep) AS n_kept,
    list_distinct(flatten(list(t) FILTER (WHERE keep))) AS t FROM kept GROUP BY 1),
gated AS (SELECT query_id, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(n_scored, 0) AS BIGINT) AS n_scored, CAST(coalesce(n_safe, 0) AS BIGINT) AS n_safe, top, CAST(coalesce(n_strong, 0) AS BIGINT) AS n_strong,
    CAST(coalesce(n_kept, 0) AS BIGINT) AS n_kept, round(CASE WHEN len(q) = 0 AND q_subject = 'mathematics' THEN 1 WHEN len(q) > 0 AND n_kept > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0 END, 6) AS overlap FROM asked LEFT JOIN sums USING (query_id)),
verdict AS (SELECT *, n > 0 AND n_scored > 0 AND n_safe > 0 AND n_strong >= 1 AND n_kept > 0 AND overlap >= 0.15 AS sufficient FROM gated)"""
)


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.substring(F.try_element_at(tx.lines(F.col("text")), F.lit(1)), 1, 60)
    docs = corpus.with_lineage(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    docs = docs.select("doc_id", "text", "grade", "subject", rules.partition(title, F.col("text"), F.lit(None).cast("string")).alias("content_partition"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("").alias("source"), "text")
    asked = corpus.with_lineage(asked).select(F.col("doc_id").alias("query_id"), "text", "grade", "subject")
    return rt.gate(_selected(spark, sf_dir), asked, docs)


@query(
    f"""WITH {_SCOPED} SELECT query_id, n, n_scored, n_safe, top, n_strong, n_kept, overlap, sufficient,
    CASE WHEN n = 0 THEN 'none' WHEN n_scored = 0 THEN 'unknown' WHEN n_safe = 0 THEN 'none' WHEN NOT sufficient THEN 'insufficient' WHEN top >= 4 AND n_strong >= 3 THEN 'high' WHEN top >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM verdict"""
)
def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gate(spark, sf_dir)


@query(
    f"""WITH {_SCOPED}, made AS (SELECT *, CASE WHEN n = 0 THEN 1 WHEN n_scored = 0 THEN 2 WHEN n_safe = 0 THEN 3 ELSE 8 END AS made FROM verdict)
    SELECT query_id, unnest(['candidates_exist', 'reranked', 'safe_partition', 'reranker_confidence', 'mutually_relevant_chunks', 'scope_match', 'query_term_overlap', 'minimum_chunks'][1:made]) AS check_name,
    unnest([n > 0, n_scored > 0, n_safe > 0, n_strong >= 1, n_strong >= 1, n_kept > 0, overlap >= 0.15, n_kept >= 1][1:made]) AS passed,
    unnest(([n, n_scored, n_safe, top, n_strong, n_kept, round(overlap, 4), n_kept]::DOUBLE[])[1:made]) AS value FROM made"""
)
def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.gate_checks(_gate(spark, sf_dir))


@query(
    f"""WITH {_LEXICAL}, u AS (SELECT query_id, doc_id, 'fulltext' AS channel, rank, score, 1.0 / (60 + rank) AS part FROM lexical UNION ALL SELECT query_id, doc_id, 'coverage', rank, score, 0.5 / (60 + rank) FROM covering)
    SELECT query_id, doc_id, max(CASE WHEN channel = 'fulltext' THEN score END) AS fulltext_score, max(CASE WHEN channel = 'coverage' THEN score END) AS coverage_score,
    round(sum(part), 8) AS rrf_score, string_agg(channel || '=' || CAST(CAST(round(part * 100000000) AS BIGINT) AS VARCHAR), ',' ORDER BY channel) AS contributions, arg_max(channel, row(part, channel)) AS best_channel FROM u GROUP BY 1, 2"""
)
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rt.merge_candidates(_channels(spark, sf_dir), "doc_id")
    return rows.select("query_id", "doc_id", "fulltext_score", "coverage_score", "rrf_score", rt.told(F.col("contributions")).alias("contributions"), "best_channel")


@query(
    rf"""SELECT item_id, CASE WHEN len(t) > 1 THEN '"' || array_to_string(t, ' ') || '"^3 OR ' ELSE '' END || array_to_string(t, ' OR ') AS lucene
    FROM (SELECT item_id, list_sort({_terms(_TOK)}) AS t FROM benchmark)"""
)
def lexical_query_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search strings of the questions: all terms as a boosted phrase, or any of them."""
    return table(spark, sf_dir, "benchmark").select("item_id", tx.lucene_query(F.sort_array(tx.query_terms(F.col("text")))).alias("lucene"))


_INSTANCES = f"len(list_filter({_TOK}, lambda x: regexp_matches(x, '{tx.INSTANCE}')))"
_RULE_WORDS = f"list_filter({_TOK}, lambda x: length(x) > 2 AND NOT list_contains([{_STOP}], x) AND NOT list_contains([{', '.join(f'{chr(39)}{w}{chr(39)}' for w in tx.OPERATION_WORDS)}], x) AND NOT regexp_matches(x, '{tx.INSTANCE}'))"


@query(
    f"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{tx.DERIVATIVE_CUE}') AND regexp_matches(text, '{tx.BRACKET_POWER}') THEN '{tx.CHAIN_RULE}' WHEN regexp_matches(text, '{tx.DERIVATIVE_CUE}') THEN '{tx.POWER_RULE}'
    WHEN {_INSTANCES} > 0 AND len({_RULE_WORDS}) > 0 THEN array_to_string({_RULE_WORDS}, ' ') ELSE trim(text) END AS search FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)"""
)
def maths_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn would be searched as in mathematics: the rule it is about, without the numbers of its exercise."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.maths_query(F.col("text")).alias("search"))


@query(
    f"""WITH {_LEXICAL}, rel AS (SELECT item_id AS query_id, doc_id, 1 AS gain FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    ideal AS (SELECT query_id, count(*) AS total, sum(CASE WHEN r <= 20 THEN 1 / log2(r + 1) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS r FROM rel) GROUP BY 1),
    got AS (SELECT query_id, count(*) AS hits, max(1 / rank) AS rr, sum(1 / log2(rank + 1)) AS dcg FROM fused JOIN rel USING (query_id, doc_id) GROUP BY 1)
    SELECT count(*) AS n_queries, round(avg(coalesce(hits / total, 0)), 4) AS recall, round(avg(coalesce(rr, 0)), 4) AS mrr, round(avg(coalesce(dcg / idcg, 0)), 4) AS ndcg FROM ideal LEFT JOIN got USING (query_id)"""
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    relevant = rt.holding(_documents(spark, sf_dir), _questions(spark, sf_dir)).withColumn("gain", F.lit(1))
    return rt.ir_metrics(rrf_fusion(spark, sf_dir), relevant)


# -- events, inspection, store ------------------------------------------------------------------------------------


@query(
    "SELECT user_id, count(*) AS n_events, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_errors, round(sum(value), 4) AS total, "
    "arg_max(event_type, row(ts, event_id)) AS last_event FROM events GROUP BY 1"
)
def event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.fold(table(spark, sf_dir, "events"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 6) AS longest FROM events WHERE value > 0 GROUP BY 1")
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("value > 0")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 6).alias("longest"))


@query("WITH r AS (SELECT user_id, max(row(ts, event_id)) AS latest, count(*) AS n_events FROM events GROUP BY 1) SELECT user_id, n_events FROM r ORDER BY latest DESC LIMIT 20")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("at"), F.count("*").alias("n_events"))
    return rows.orderBy(F.desc("at")).limit(20).select("user_id", "n_events")


@query("SELECT event_id, 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame FROM events")
def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("event: "), "event_type", F.lit("\ndata: "), "props", F.lit("\n\n")).alias("frame"))


@query(SQL["event_fold"])
def stream_event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.finished_fold(spark, sf_dir)


@query(f"WITH {_CHUNKS} SELECT grade, subject, count(DISTINCT unit_id) AS units, count(DISTINCT document_id) AS documents, count(*) AS n_chunks FROM chunks GROUP BY 1, 2")
def coverage_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunks(spark, sf_dir).groupBy("grade", "subject").agg(
        F.countDistinct("unit_id").alias("units"), F.countDistinct("document_id").alias("documents"), F.count("*").alias("n_chunks")
    )


@query("SELECT count(*) AS total, count(embedding) AS present, sum(CASE WHEN len(embedding) = 64 THEN 1 ELSE 0 END)::BIGINT AS current FROM embeddings")
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("total"), F.count("embedding").alias("present"), F.sum((F.size("embedding") == 64).cast("long")).alias("current"))


@query("SELECT source, lang, count(*) AS n, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS chars FROM documents GROUP BY 1, 2")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("chars"))


@query(f"WITH {_CHUNKS} SELECT unit_id, count(DISTINCT document_id) AS documents, count(DISTINCT section_id) AS sections, count(*) AS n_chunks FROM chunks GROUP BY 1")
def unit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunks(spark, sf_dir).groupBy("unit_id").agg(F.countDistinct("document_id").alias("documents"), F.countDistinct("section_id").alias("sections"), F.count("*").alias("n_chunks"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def orphan_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    orders = table(spark, sf_dir, "orders").where(urgent).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query(
    "SELECT r_name, n_name, c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey "
    "JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2, 3"
)
def lineage_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def optional_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return joined.groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"))


@query(
    "SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3"
)
def top_lines_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.row_number().over(order).alias("rank"))
    return rows.where(F.col("rank") <= 3)


@query("SELECT d.doc_id, md5(text) AS digest FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def incremental_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(done, "doc_id", "left_anti").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return rows


# -- titles, answers, evidence, chunk packing, purge ---------------------------------------------------------------


def _in(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_CONCEPTS = (
    _CHUNKS
    + rf""",
titles AS (SELECT DISTINCT section_title FROM chunks),
cleaned AS (SELECT section_title, trim(regexp_replace(section_title, '\s+', ' ', 'g')) AS flat, trim(regexp_replace(regexp_replace(section_title, '{cn.PREFIX}', ''), '\s+', ' ', 'g')) AS cut FROM titles),
pieces AS (SELECT section_title, unnest(list_concat([clean], regexp_split_to_array(clean, '{cn.SEPARATOR}'))) AS raw FROM (SELECT section_title, CASE WHEN cut = '' THEN flat ELSE cut END AS clean FROM cleaned)),
phrases AS (SELECT DISTINCT section_title, regexp_replace(raw, '{cn.EDGES}', '', 'g') AS phrase FROM pieces),
plain AS (SELECT section_title, phrase, trim(regexp_replace(lower(trim(regexp_replace(regexp_replace(replace(phrase, '-', ' '), '{cn.PUNCTUATION}', ' ', 'g'), '\s+', ' ', 'g'))), '^(?:the|a|an)\s+', '')) AS p FROM phrases WHERE phrase <> ''),
singular AS (SELECT section_title, phrase, CASE WHEN length(w) > 4 AND ends_with(w, 'ies') THEN regexp_replace(p, 'ies$', 'y')
  WHEN length(w) > 4 AND ends_with(w, 's') AND NOT regexp_matches(w, '{cn.NOT_PLURAL}') THEN regexp_replace(p, 's$', '') ELSE p END AS concept
  FROM (SELECT *, regexp_extract(p, '(\S+)$', 1) AS w FROM plain)),
split_ AS (SELECT *, string_split(concept, ' ') AS ws FROM singular),
title_concepts AS (SELECT DISTINCT section_title, concept FROM split_ WHERE length(phrase) >= {cn.MIN_CHARS} AND length(concept) >= {cn.MIN_CHARS} AND regexp_matches(phrase, '\p{{L}}')
  AND NOT regexp_matches(phrase, '{cn.STRUCTURE}') AND NOT list_contains({_in(cn.BLOCKED_PHRASES)}, concept) AND NOT list_contains({_in(cn.BLOCKED_PHRASES)}, lower(phrase))
  AND len(ws) <= {cn.MAX_WORDS} AND len(list_filter(ws, lambda x: NOT list_contains({_in(cn.STOP_WORDS)}, x))) > 0
  AND len(list_filter(ws, lambda x: regexp_matches(x, '{cn.CODE}'))) = 0 AND NOT regexp_matches(ws[1], '{cn.SHORT}')
  AND 2 * len(list_filter(ws, lambda x: regexp_matches(x, '{cn.SHORT}'))) < len(ws)
  AND (len(ws) > 1 OR (length(concept) >= 5 AND NOT list_contains({_in(cn.BLOCKED_WORDS + cn.STOP_WORDS)}, concept))))"""
)


def _title_concepts(chunk_rows: DataFrame) -> DataFrame:
    each = chunk_rows.select("section_title").distinct().select("section_title", F.explode(cn.title_pieces(F.col("section_title"))).alias("phrase"))
    each = each.withColumn("concept", cn.normal_form(F.col("phrase")))
    return each.where(cn.is_concept(F.col("phrase"), F.col("concept"))).select("section_title", "concept").distinct()


@query(f"WITH {_CONCEPTS} SELECT section_title, concept FROM title_concepts")
def title_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _title_concepts(corpus.chunks(spark, sf_dir))


@query(
    f"""WITH {_CONCEPTS} SELECT concept, count(*) AS support FROM title_concepts GROUP BY 1
    HAVING count(*) >= CASE WHEN contains(concept, ' ') THEN 1 ELSE 2 END"""
)
def phrase_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _title_concepts(corpus.chunks(spark, sf_dir)).groupBy("concept").agg(F.count("*").alias("support"))
    return counted.where(F.col("concept").contains(" ") | (F.col("support") >= 2))


_NORMAL = (
    r"(SELECT CASE WHEN length(w) > 4 AND ends_with(w, 'ies') THEN regexp_replace(p, 'ies$', 'y') WHEN length(w) > 4 AND ends_with(w, 's') AND NOT regexp_matches(w, '" + cn.NOT_PLURAL
    + r"') THEN regexp_replace(p, 's$', '') ELSE p END FROM (SELECT p, regexp_extract(p, '(\S+)$', 1) AS w FROM (SELECT trim(regexp_replace(form, '^(?:the|a|an)\s+', '')) AS p)))"
)
_PHRASES = (
    _CONCEPTS
    + rf""",
known AS (SELECT concept FROM title_concepts GROUP BY 1 HAVING count(*) >= CASE WHEN contains(concept, ' ') THEN 1 ELSE 2 END),
surface AS (SELECT DISTINCT unnest([concept, lower(trim(regexp_replace(regexp_replace(replace(phrase, '-', ' '), '{cn.PUNCTUATION}', ' ', 'g'), '\s+', ' ', 'g')))]) AS form
  FROM split_ JOIN title_concepts USING (section_title, concept) WHERE concept IN (SELECT concept FROM known) AND length(phrase) >= {cn.MIN_CHARS}),
spelled AS (SELECT DISTINCT unnest(CASE WHEN regexp_matches(form, '{cn.NOT_PLURAL}') THEN [form] ELSE [form, form || 's'] END) AS form FROM surface WHERE form <> ''),
forms AS (SELECT form, concept FROM (SELECT form, {_NORMAL} AS concept FROM spelled) WHERE concept IN (SELECT concept FROM known)),
segment AS (SELECT chunk_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_\s-]+')) AS seg, generate_subscripts(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_\s-]+'), 1) AS si FROM chunks),
worded AS (SELECT chunk_id, si, list_filter(regexp_split_to_array(seg, '[\s-]+'), lambda x: x <> '') AS ws FROM segment),
gram AS (SELECT chunk_id, si * 100000 + i AS start, n, array_to_string(ws[i:i + n - 1], ' ') AS form
  FROM (SELECT chunk_id, si, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded), range(1, 9) t(n) WHERE i + n - 1 <= len(ws)),
spot AS MATERIALIZED (SELECT chunk_id, start, n, concept FROM gram JOIN forms USING (form)),
scanned AS (SELECT chunk_id, CAST(0 AS BIGINT) AS free, CAST(NULL AS VARCHAR) AS concept FROM (SELECT DISTINCT chunk_id FROM spot)
  UNION ALL SELECT chunk_id, b.start + b.n, b.concept FROM (SELECT s.chunk_id, arg_min(struct_pack(start := s.start, n := s.n, concept := s.concept), row(s.start, -s.n)) AS b
    FROM scanned JOIN spot s ON s.chunk_id = scanned.chunk_id AND s.start >= scanned.free GROUP BY s.chunk_id)),
in_text AS (SELECT chunk_id, concept, count(*) AS occurrences FROM scanned WHERE concept IS NOT NULL GROUP BY 1, 2),
unit_titles AS (SELECT unit_id, arg_min(section_title, row(doc_id, chunk_index)) AS unit_title FROM chunks GROUP BY 1),
ordered AS (SELECT section_title AS title, concept, min(place) AS place FROM (SELECT t.section_title, t.concept, list_position(o.ps, t.phrase) AS place
  FROM split_ t JOIN (SELECT section_title, list(regexp_replace(raw, '{cn.EDGES}', '', 'g')) AS ps FROM pieces GROUP BY 1) o USING (section_title)
  JOIN title_concepts k ON k.section_title = t.section_title AND k.concept = t.concept) WHERE concept IN (SELECT concept FROM known) GROUP BY 1, 2),
own AS (SELECT chunk_id, concept, 'section_title' AS source, 0 AS o, place, title FROM chunks JOIN ordered ON title = section_title
  UNION ALL SELECT chunk_id, concept, 'unit_title', 1, place, title FROM chunks JOIN unit_titles USING (unit_id) JOIN ordered ON title = unit_title),
each_mention AS (SELECT chunk_id, concept, source, CAST(1 AS BIGINT) AS occurrences, source || ': ' || title AS evidence, o, place AS o2, 0 AS o3 FROM own
  UNION ALL SELECT chunk_id, concept, 'curriculum_term', occurrences, 'verbatim phrase match (' || occurrences || 'x)', 2, -len(string_split(concept, ' ')), -occurrences FROM in_text),
first_mention AS (SELECT * FROM each_mention QUALIFY row_number() OVER (PARTITION BY chunk_id, concept ORDER BY o, o2) = 1),
phrase_rows AS (SELECT chunk_id, concept, source, occurrences, evidence, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY o, o2, o3, concept) AS INT) AS rank FROM first_mention)"""
)


def _phrase_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.with_unit_titles(corpus.chunks(spark, sf_dir).select("chunk_id", "doc_id", "chunk_index", "unit_id", "section_title", "text"))
    found = stored(ph.title_concepts(rows, "section_title"), "titles")
    support = found.groupBy("concept").agg(F.countDistinct("section_title").alias("support"))
    return ph.mentions(rows, found, stored(support.where(F.col("concept").contains(" ") | (F.col("support") >= 2)), "vocabulary"))


@query(f"WITH RECURSIVE {_PHRASES.strip()} SELECT chunk_id, concept, source, occurrences, evidence, rank FROM phrase_rows WHERE rank <= 8")
def phrase_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of each chunk: of its own titles first, then vocabulary phrases of one to six words found in its text."""
    return _phrase_mentions(spark, sf_dir).select("chunk_id", "concept", "source", "occurrences", "evidence", "rank")


@query(
    rf"""WITH n AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), c AS (SELECT *, len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) AS k FROM n)
    SELECT conv_id, turn, CAST(k AS INT) AS n_words, regexp_matches(t, '{_q(an.LEAK)}') AS leaks, regexp_matches(t, '{_q(an.REVEALS)}') AS reveals,
    {", ".join(f"k <= {n} AS fits_{s}" for s, n in an.WORD_LIMITS.items())} FROM c"""
)
def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    flags = [an.within_limit(F.col("t"), s).alias(f"fits_{s}") for s in an.WORD_LIMITS]
    return rows.select(
        "conv_id", "turn", an.word_count(F.col("t")).alias("n_words"), F.regexp_like("t", F.lit(an.LEAK)).alias("leaks"), F.regexp_like("t", F.lit(an.REVEALS)).alias("reveals"), *flags
    )


_PAIRS = (
    "p AS (SELECT conv_id, turn, coalesce(text, '') AS t, coalesce(lead(text) OVER w, '') AS n, coalesce(lag(text) OVER w, '') AS b "
    "FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"
)
_LONG = "list_distinct(regexp_extract_all(lower({}), '[a-z]{{4,}}'))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    text = lambda c: F.coalesce(c, F.lit(""))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text(F.col("text")).alias("t"), text(F.lead("text").over(w)).alias("n"), text(F.lag("text").over(w)).alias("b")
    )


@query(
    rf"""WITH {_PAIRS} SELECT conv_id, turn, t <> '' AND NOT contains(t, '?') AND ends_with(n, '?') AND length(n) - length(replace(n, '?', '')) = 1
    {" ".join(f"AND NOT regexp_matches({c}, '{_q(p)}')" for c in "tn" for p in (an.STEPS, an.LEAK, an.REVEALS))}
    AND len(list_filter(regexp_split_to_array(t || ' ' || n, '\s+'), lambda w: w <> '')) <= 90 AS hint_ok FROM p"""
)
def hint_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", an.hint_ok(F.col("t"), F.col("n")).alias("hint_ok"))


@query(
    f"""WITH {_PAIRS}, o AS (SELECT *, len(list_intersect({_LONG.format("t")}, {_LONG.format("b")})) AS k FROM p)
    SELECT conv_id, turn, CAST(k AS INT) AS shared_words, k > 0 AND NOT regexp_matches(t, '{_q(an.DECLINE_ANSWERS)}') AS decline_ok FROM o"""
)
def turn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", an.overlap(F.col("t"), F.col("b")).alias("shared_words"), an.decline_ok(F.col("t"), F.col("b")).alias("decline_ok"))


@query(
    rf"""WITH {_CHUNKS}, f AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM chunks)
    SELECT chunk_id, CASE WHEN page_end = page_start THEN page_start::VARCHAR ELSE page_start || '-' || page_end END AS pages,
    CASE WHEN length(flat) <= 160 THEN flat ELSE flat[1:157] || '...' END AS preview,
    CASE WHEN length(flat) <= 1000 THEN flat ELSE regexp_replace(flat[1:1000], ' [^ ]*$', '') || ' ...' END AS evidence FROM f"""
)
def evidence_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return corpus.chunks(spark, sf_dir).select(
        "chunk_id", an.page_range(F.col("page_start"), F.col("page_end")).alias("pages"), an.preview(text).alias("preview"), an.evidence_text(text).alias("evidence")
    )


@query()
def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ck.packed_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Documents of sources that contain one of these are purged.
PURGED = ("src1", "src7")
_PURGED = "(" + " OR ".join(f"contains(lower(coalesce(source, '')), '{x}')" for x in PURGED) + ")"


@query(
    f"""WITH {_LINEAGE} SELECT grade, subject, count(*) AS n_documents, CAST(sum(CASE WHEN {_PURGED} THEN 1 ELSE 0 END) AS BIGINT) AS n_purged,
    count(DISTINCT CASE WHEN NOT {_PURGED} THEN unit_id END) AS n_units_left, count(DISTINCT unit_id) - count(DISTINCT CASE WHEN NOT {_PURGED} THEN unit_id END) AS n_units_orphaned,
    bool_and({_PURGED}) AS orphan FROM lineage GROUP BY 1, 2"""
)
def source_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when the named sources go: units, then subjects and grades, without documents are orphans."""
    docs = corpus.with_lineage(table(spark, sf_dir, "documents").select("doc_id", "source"))
    name = F.lower(F.coalesce("source", F.lit("")))
    gone = name.contains(PURGED[0]) | name.contains(PURGED[1])
    units = docs.groupBy("grade", "subject", "unit_id").agg(F.count("*").alias("n"), F.sum(gone.cast("long")).alias("p"))
    left = (F.col("p") < F.col("n")).cast("long")
    return units.groupBy("grade", "subject").agg(
        F.sum("n").alias("n_documents"), F.sum("p").alias("n_purged"), F.sum(left).alias("n_units_left"), F.sum(1 - left).alias("n_units_orphaned"), (F.sum(left) == 0).alias("orphan")
    )


@query(
    f"""WITH {_CHUNKS} SELECT source, count(DISTINCT document_id) AS n_documents, count(DISTINCT section_id) AS n_sections, count(*) AS n_chunks,
    CAST(sum(page_end - page_start + 1) AS BIGINT) AS n_page_edges FROM chunks GROUP BY 1"""
)
def source_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = corpus.chunks(spark, sf_dir).groupBy("source", "document_id").agg(
        F.countDistinct("section_id").alias("s"), F.count("*").alias("c"), F.sum(F.col("page_end") - F.col("page_start") + 1).alias("e")
    )
    return per.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("s").alias("n_sections"), F.sum("c").alias("n_chunks"), F.sum("e").alias("n_page_edges"))


_HEX = "CAST('0x' || substring(md5(t), 1, 4) AS INT)"


@query(
    f"""WITH e AS (SELECT doc_id, unnest({_TOK}) AS t FROM documents),
    d AS (SELECT doc_id, CAST({_HEX} % 64 AS INT) AS dim, CAST(sum(CASE WHEN ({_HEX} // 64) % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS v FROM e GROUP BY 1, 2)
    SELECT doc_id, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM d WHERE v <> 0"""
)
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rt.hashed_embeddings(docs)


from marlstone.plans import graph_queries, inspect_queries, run_queries, section_queries, store_queries, tutor_queries  # noqa: E402, F401  these register themselves
