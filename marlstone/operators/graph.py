"""Graph retrieval: seeds from ranked channels, bounded weighted expansion, and the trace of what was examined and why.

Neighbours are found once for each distinct seed; what depends on a request (weights, scope, choice, trace) is joined to them afterwards.
Arrival order, where it matters, is that of the seed (by weight), the relation (as listed) and the position in its relation.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.scope import BRANCHES
from marlstone.session import stored

#: Relations between chunks with their weights, in the order they are tried, and how many hops each takes.
RELATIONS = {"SAME_SECTION": 1.0, "ADJACENT": 0.9, "SAME_PAGE": 0.7, "SHARED_CONCEPT": 0.6, "SAME_LESSON": 0.5}
HOPS = {"SAME_SECTION": 1, "ADJACENT": 1, "SAME_PAGE": 1, "SHARED_CONCEPT": 2, "SAME_LESSON": 2}
#: How a relation is stored; one that is not is drawn as a logical edge.
STORED_AS = {"SAME_SECTION": "HAS_CHUNK", "ADJACENT": "NEXT|PREVIOUS", "SAME_PAGE": "ON_PAGE", "SHARED_CONCEPT": "MENTIONS"}
SEEDS, PER_RELATION, TRACE_LIMIT, TOP_K, MOST_NODES, HUB = 10, 8, 50, 20, 1000, 400


def _looked_up(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _millionths(value: Column) -> Column:
    """Rounded to six places after the product with 1e6, as SQL engines round doubles; weights often lie halfway, where rounding by the printed digits gives another last place."""
    return F.round(value * 1e6) / 1e6


RELATION_NUMBER = {r: i for i, r in enumerate(RELATIONS)}


def enabled(depth: int) -> tuple[str, ...]:
    """Relations that a depth allows."""
    return tuple(r for r in RELATIONS if HOPS[r] <= depth)


def relation_decisions(spark, depth: int) -> DataFrame:
    """relation, hops, enabled, reason: which relations a depth leaves out."""
    rows = [(r, HOPS[r], HOPS[r] <= depth, None if HOPS[r] <= depth else "RELATION_DISABLED_BY_DEPTH") for r in RELATIONS]
    return spark.createDataFrame(rows, "relation string, hops int, enabled boolean, reason string")


def select_seeds(channels: list[DataFrame], key: str = "chunk_id", limit: int = SEEDS) -> DataFrame:
    """query_id, seed_id, weight, seed_rank: the best of several ranked channels; a seed weighs 1 / rank in the channel where it ranks best."""
    hits = reduce(DataFrame.unionByName, [c.select("query_id", F.col(key).alias("seed_id"), (F.lit(1.0) / F.col("rank")).alias("w")) for c in channels])
    best = hits.groupBy("query_id", "seed_id").agg(_millionths(F.max("w")).alias("weight"))
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "seed_id")
    return best.withColumn("seed_rank", F.row_number().over(order)).where(F.col("seed_rank") <= limit)


def expand(seeds: DataFrame, chunk_rows: DataFrame, pages: DataFrame, mentions: DataFrame, limit: int = PER_RELATION, relations: tuple[str, ...] = tuple(RELATIONS), seed_rows: DataFrame | None = None) -> DataFrame:
    """seed_id, relation, chunk_id, via, position: neighbours of each distinct seed_id, at most ``limit`` a pair of seed and relation.

    ``mentions`` has chunk_id, concept. A seed is never its own neighbour; the order within a relation is by neighbour and via. Each branch gives a row
    once, so the limit is the only step after the union, and Spark applies it in each task before rows are shuffled. ``seed_rows`` may give the rows of the
    seeds; what the large tables are joined to is stored first, so that Spark knows how small it is.
    """
    c = chunk_rows.select("chunk_id", "section_id", "document_id", "unit_id", "section_title", "chunk_index")
    s = c.join(seeds.select(F.col("seed_id").alias("chunk_id")).distinct(), "chunk_id", "left_semi") if seed_rows is None else seed_rows.select(*c.columns)
    s = stored(s.select([F.col(x).alias(f"s_{x}") for x in c.columns]), "seeds")
    none, other = F.lit(None).cast("string"), F.col("chunk_id") != F.col("s_chunk_id")

    def same_section() -> tuple[DataFrame, Column]:
        return s.join(c, (F.col("s_section_id") == F.col("section_id")) & other), none

    def adjacent() -> tuple[DataFrame, Column]:
        beside = F.explode(F.array(F.col("s_chunk_index") - 1, F.col("s_chunk_index") + 1))
        return s.withColumn("at", beside).join(c, (F.col("s_document_id") == F.col("document_id")) & (F.col("at") == F.col("chunk_index"))), none

    def same_page() -> tuple[DataFrame, Column]:
        own = stored(pages.join(s.select("s_chunk_id"), F.col("chunk_id") == F.col("s_chunk_id")).select("s_chunk_id", "page_id"), "pages")
        return own.join(pages, "page_id").where(other), F.col("page_id")

    def shared_concept() -> tuple[DataFrame, Column]:
        known = stored(mentions.join(s.select("s_chunk_id"), F.col("chunk_id") == F.col("s_chunk_id")).select("s_chunk_id", "concept"), "known")
        return known.join(mentions, "concept").where(other), F.col("concept")

    def same_lesson() -> tuple[DataFrame, Column]:
        alike = (F.col("s_unit_id") == F.col("unit_id")) & (F.col("s_section_title") == F.col("section_title")) & (F.col("s_document_id") != F.col("document_id"))
        return s.join(c, alike), none

    branches = {"SAME_SECTION": same_section, "ADJACENT": adjacent, "SAME_PAGE": same_page, "SHARED_CONCEPT": shared_concept, "SAME_LESSON": same_lesson}
    rows = []
    for name in relations:
        found, via = branches[name]()
        rows.append(found.select(F.col("s_chunk_id").alias("seed_id"), F.lit(name).alias("relation"), "chunk_id", via.alias("via")))
    place = F.row_number().over(Window.partitionBy("seed_id", "relation").orderBy("chunk_id", "via"))
    return reduce(DataFrame.unionByName, rows).withColumn("position", place).where(F.col("position") <= limit)


def requested(paths: DataFrame, seeds: DataFrame, scope: DataFrame, requests: DataFrame, per_relation: int = PER_RELATION) -> DataFrame:
    """The paths of each request's seeds, in arrival order (seq), with what its scope says of the neighbour.

    ``scope`` has chunk_id, grade, subject and content_partition; ``requests`` has query_id, q_grade and q_subject. A path is primary if it is
    within the limit of its relation, its neighbour in scope and of a production partition; ``detail`` names what doesn't fit the scope.
    """
    lineage = (F.col("subject") == F.col("q_subject")) | (F.col("q_subject").isin(*BRANCHES) & (F.col("subject") == "science"))
    late, strange = ~F.coalesce(F.col("grade") <= F.col("q_grade"), F.lit(False)), ~F.coalesce(lineage, F.lit(False))
    safe = F.coalesce("content_partition", F.lit("student_evidence")).isin("student_evidence", "teacher_strategy")
    rows = paths.join(seeds, "seed_id").join(scope.select("chunk_id", "grade", "subject", "content_partition"), "chunk_id").join(requests.select("query_id", "q_grade", "q_subject"), "query_id")
    detail = F.concat_ws(
        "; ", F.when(late, F.concat(F.lit("grade "), F.coalesce(F.col("grade").cast("string"), F.lit("none")), F.lit(" > "), "q_grade")), F.when(strange, F.concat(F.lit("subject "), F.coalesce("subject", F.lit("none")), F.lit(" not in lineage "), "q_subject"))
    )
    inside = ~late & ~strange
    primary = (F.col("position") <= per_relation) & inside & safe
    seq = F.struct((~primary).alias("diagnostic"), "seed_rank", _looked_up(RELATION_NUMBER, F.col("relation")).alias("relation_number"), "position")
    return rows.select("query_id", "seed_id", "weight", "relation", "chunk_id", "via", "position", inside.alias("inside"), primary.alias("is_primary"), detail.alias("detail"), seq.alias("seq"))


def graph_ranked(rows: DataFrame, seeds: DataFrame, k: int = TOP_K) -> DataFrame:
    """query_id, chunk_id, score, rank, n_paths, first_seed, path: the neighbours of most weight over all primary paths of a request; seeds are left out.

    ``path`` lists the first three ways to the neighbour in the order of their arrival; weights are added in that order, so the score doesn't depend on how rows are dealt to tasks.
    """
    own = seeds.select("query_id", F.col("seed_id").alias("chunk_id"))
    reached = rows.where("is_primary").join(own, ["query_id", "chunk_id"], "left_anti")
    told = F.concat("relation", F.when(F.col("via").isNotNull(), F.concat(F.lit(" via "), "via")).otherwise(""), F.lit(" from "), "seed_id")
    part = F.col("weight") * _looked_up(RELATIONS, F.col("relation"))
    gathered = reached.groupBy("query_id", "chunk_id").agg(
        F.count("*").alias("n_paths"),
        F.min_by("seed_id", "seq").alias("first_seed"),
        F.sort_array(F.collect_list(F.struct("seq", told.alias("told"), part.alias("part")))).alias("ways"),
    )
    gathered = gathered.withColumn("score", _millionths(F.aggregate("ways", F.lit(0.0), lambda total, w: total + w["part"])))
    path = F.array_join(F.slice(F.array_distinct(F.transform("ways", lambda w: w["told"])), 1, 3), "; ")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ranked = gathered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "chunk_id", "score", "rank", "n_paths", "first_seed", path.alias("path"))


def traverse(seeds: DataFrame, neighbours: Callable[[DataFrame], DataFrame], levels: int = 2, limit: int = SEEDS, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """query_id, chunk_id, level, weight: chunks reached from the seeds, level by level.

    A chunk weighs the greatest product of its origin's weight and the relation's over the paths that lead to it from the level before; the ``limit``
    heaviest new ones of each request are the next frontier. ``neighbours`` gives seed_id, relation and chunk_id for a table of seed_id; ``keep`` may
    write a frontier down, so that later levels don't compute it again.
    """
    keep = keep or (lambda df, name: df)
    frontier = keep(seeds.select("query_id", F.col("seed_id").alias("chunk_id"), F.lit(0).alias("level"), "weight"), "frontier")
    reached = frontier
    for level in range(1, levels + 1):
        paths = neighbours(frontier.select(F.col("chunk_id").alias("seed_id")).distinct())
        along = paths.join(frontier.select("query_id", F.col("chunk_id").alias("seed_id"), "weight"), "seed_id")
        met = along.groupBy("query_id", "chunk_id").agg(_millionths(F.max(F.col("weight") * _looked_up(RELATIONS, F.col("relation")))).alias("weight"))
        new = met.join(reached.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "chunk_id"))
        new = new.withColumn("_n", place).where(F.col("_n") <= limit)
        frontier = keep(new.select("query_id", "chunk_id", F.lit(level).alias("level"), "weight"), "frontier")
        reached = reached.unionByName(frontier)
    return reached


def classify(rows: DataFrame, seeds: DataFrame, selected: DataFrame, per_relation: int = PER_RELATION, limit: int = TRACE_LIMIT) -> DataFrame:
    """Every path of a request with the first reason that applies to it, its detail, and whether it is accepted.

    Paths beyond the safety limit are told but not examined. The first path examined that leads to a selected chunk is accepted; a path that was seen
    before, or leads to a chunk that another path led to, is a duplicate.
    """
    own = seeds.select("query_id", F.col("seed_id").alias("chunk_id"), F.lit(True).alias("is_seed"))
    chosen = selected.select("query_id", "chunk_id", F.lit(True).alias("is_chosen"))
    cut = ~F.col("is_primary") & (F.col("position") > limit)
    rows = rows.withColumn("_cut", cut).join(own, ["query_id", "chunk_id"], "left").join(chosen, ["query_id", "chunk_id"], "left")
    again = F.row_number().over(Window.partitionBy("query_id", "_cut", "seed_id", "relation", "via", "chunk_id").orderBy("seq")) > 1
    nth = F.row_number().over(Window.partitionBy("query_id", "_cut", "chunk_id").orderBy("seq"))
    diagnostic = ~F.col("is_primary")
    reason = (
        F.when(F.col("_cut"), "TRACE_SAFETY_LIMIT")
        .when(F.col("is_seed"), "SEED_NODE")
        .when(F.col("_again"), "DUPLICATE_PATH")
        .when(diagnostic & ~F.col("inside"), "METADATA_FILTER_MISMATCH")
        .when(diagnostic & (F.col("position") > per_relation), "PER_RELATION_LIMIT")
        .when(F.col("is_chosen") & (F.col("_nth") == 1), "SELECTED_GRAPH_CANDIDATE")
        .when(F.col("is_chosen"), "DUPLICATE_PATH")
        .otherwise("GRAPH_TOP_K_CUTOFF")
    )
    out = rows.withColumns({"_again": again, "_nth": nth}).withColumn("reason", reason)
    detail = F.when(F.col("reason") == "METADATA_FILTER_MISMATCH", F.col("detail"))
    contribution = F.when(F.col("_cut"), 0.0).otherwise(_millionths(F.col("weight") * _looked_up(RELATIONS, F.col("relation"))))
    accepted = F.col("reason") == "SELECTED_GRAPH_CANDIDATE"
    return out.select(
        "query_id", "seed_id", "relation", "chunk_id", "via", "position", "seq", "reason", detail.alias("detail"), contribution.alias("contribution"), accepted.alias("accepted"),
        F.coalesce("is_chosen", F.lit(False)).alias("is_chosen"),
    )


def _via_id() -> Column:
    return F.when(F.col("relation") == "SHARED_CONCEPT", F.concat(F.lit("concept:"), "via")).otherwise(F.col("via"))


def hub_rows(seeds: DataFrame, mentions: DataFrame, hubs: DataFrame) -> DataFrame:
    """query_id, seed_id, concept, mention_count: hub concepts that a request's seeds mention and that no path goes through."""
    of_seed = mentions.select(F.col("chunk_id").alias("seed_id"), "concept").join(hubs.select("concept", "mention_count"), "concept")
    return seeds.select("query_id", "seed_id").join(of_seed, "seed_id")


def trace_nodes(traced: DataFrame, seeds: DataFrame, hubs: DataFrame, ranked: DataFrame, fused: DataFrame, evidence: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """One row for each node of a request's trace.

    What the paths say of a node is folded over a lattice: kind and label are those it was first seen with, accepted is greater than any other status, reasons gather in the order
    they came up, of each further field the last value that is there counts. ``most`` nodes of a request are kept, those seen first. Nodes
    that went on to fusion or to the final evidence are marked, and evidence is then their status.
    """
    number = lambda step: F.struct(F.lit(step).alias("step"), F.lit(None).cast("struct<diagnostic:boolean,seed_rank:int,relation_number:int,position:int>").alias("seq"), F.lit(0).alias("part"))
    of_path = lambda part: F.struct(F.lit(2).alias("step"), F.col("seq"), F.lit(part).alias("part"))
    fields = {"reason": "string", "seed_weight": "double", "mention_count": "long", "via_for": "string", "visual": "string"}

    def seen(df: DataFrame, node: Column, label, kind: str, status, at: Column, **has: Column) -> DataFrame:
        more = [has.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields.items()]
        return df.select("query_id", node.alias("node_id"), label.alias("label"), F.lit(kind).alias("kind"), status.alias("status"), at.alias("at"), *more)

    status = F.when(F.col("is_chosen") & (F.col("reason") != "METADATA_FILTER_MISMATCH"), "accepted").otherwise("ignored")
    visual = F.when(F.col("reason") == "METADATA_FILTER_MISMATCH", "metadata_mismatch").otherwise(status)
    context_label = F.when(F.col("relation") == "SHARED_CONCEPT", "Concept").otherwise("Page")
    every = [
        seen(seeds, F.col("seed_id"), F.lit("Chunk"), "seed", F.lit("seed"), number(0), seed_weight=F.col("weight")),
        seen(hubs, F.concat(F.lit("concept:"), "concept"), F.lit("Concept"), "hub", F.lit("ignored"), number(1), reason=F.lit("HUB_CONCEPT_EXCLUDED"), mention_count=F.col("mention_count")),
        seen(traced, F.col("chunk_id"), F.lit("Chunk"), "candidate", status, of_path(0), reason=F.col("reason"), visual=visual),
        seen(traced.where("via IS NOT NULL"), _via_id(), context_label, "context", F.lit("context"), of_path(1), via_for=F.col("relation")),
    ]
    rows = reduce(DataFrame.unionByName, every)
    # reasons first, a row for each, so that a node of very many paths is small when its reasons are gathered
    by_reason = rows.groupBy("query_id", "node_id", "reason").agg(
        F.min("at").alias("at"), F.min_by(F.struct("label", "kind", "status"), "at").alias("first"), F.max((F.col("status") == "accepted").cast("int")).alias("accepted"), F.count("*").alias("n"),
        *[F.max(F.when(F.col(f).isNotNull(), F.struct("at", F.col(f).alias("value")))).alias(f) for f in fields if f != "reason"],
    )
    nodes = by_reason.groupBy("query_id", "node_id").agg(
        F.min("at").alias("at"), F.min_by("first", "at").alias("first"), F.max("accepted").alias("accepted"), F.sum(F.when(F.col("reason").isNotNull(), F.col("n"))).alias("n_told"),
        F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("at", "reason")))).alias("told"), *[F.max(f)["value"].alias(f) for f in fields if f != "reason"],
    )
    kept = nodes.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "node_id"))).where(F.col("_n") <= most)
    flag = lambda df, name: df.select("query_id", F.col("chunk_id").alias("node_id"), F.lit(True).alias(name))
    scores = ranked.select("query_id", F.col("chunk_id").alias("node_id"), F.col("score").alias("graph_score"))
    kept = kept.join(scores, ["query_id", "node_id"], "left").join(flag(fused, "entered_fusion"), ["query_id", "node_id"], "left").join(flag(evidence, "final_evidence"), ["query_id", "node_id"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    own = F.when(F.col("accepted") == 1, "accepted").otherwise(F.col("first.status"))
    shown = yes("final_evidence") & F.col("first.kind").isin("seed", "candidate")
    return kept.select(
        "query_id", "node_id", "first.label", "first.kind", F.when(shown, "evidence").otherwise(own).alias("status"), F.array_join(F.transform("told", lambda t: t["reason"]), ",").alias("reasons"),
        F.coalesce("n_told", F.lit(0)).alias("n_told"), "seed_weight", "graph_score", "mention_count", "via_for", F.when(shown, "evidence").otherwise(F.col("visual")).alias("visual"),
        yes("entered_fusion").alias("entered_fusion"), yes("final_evidence").alias("final_evidence"),
    )


def trace_edges(traced: DataFrame, hubs: DataFrame) -> DataFrame:
    """query_id, source, target, relation, physical, accepted, n_paths: how the trace's nodes are joined.

    A relation that is not stored is one logical edge; one through a page or a concept is two stored edges; any other is one. An edge is accepted if any of its paths is.
    """
    kind = _looked_up(STORED_AS, F.col("relation"))
    logical, through = ~F.col("relation").isin(*STORED_AS), F.col("via").isNotNull()
    edge = lambda a, b, relation, physical: F.struct(a.alias("source"), b.alias("target"), relation.alias("relation"), F.lit(physical).alias("physical"))
    direct = F.array(edge(F.col("seed_id"), F.col("chunk_id"), F.col("relation"), True))
    edges = (
        F.when(logical, F.array(edge(F.col("seed_id"), F.col("chunk_id"), F.col("relation"), False)))
        .when(through, F.array(edge(F.col("seed_id"), _via_id(), kind, True), edge(_via_id(), F.col("chunk_id"), kind, True)))
        .otherwise(direct)
    )
    each = traced.select("query_id", "accepted", F.explode(edges).alias("e")).select("query_id", "e.*", "accepted")
    excluded = hubs.select("query_id", F.col("seed_id").alias("source"), F.concat(F.lit("concept:"), "concept").alias("target"), F.lit("MENTIONS").alias("relation"), F.lit(True).alias("physical"), F.lit(False).alias("accepted"))
    return each.unionByName(excluded).groupBy("query_id", "source", "target", "relation", "physical").agg(F.max("accepted").alias("accepted"), F.count("*").alias("n_paths"))


def neighbourhood(paths: DataFrame, limit: int = 15) -> DataFrame:
    """seed_id, chunk_id, relations, position: the distinct one-hop neighbours of a chunk, ``limit`` at most."""
    rows = paths.where(_looked_up(HOPS, F.col("relation")) == 1).groupBy("seed_id", "chunk_id").agg(F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("seed_id").orderBy("chunk_id"))).where(F.col("position") <= limit)
