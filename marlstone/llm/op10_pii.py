"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides.

1. Candidate spans come from strict patterns (the base kinds) and from wider ones (written-out
   e-mail addresses, local telephone numbers, national numbers, credentials, titled names).
2. Five labelers vote on each candidate (1 for, -1 against, 0 silent): strict pattern, variety of
   characters, key words before it, a gazetteer, clean borders.
3. Expectation-maximisation over the counts of vote patterns (at most 3**5 for each kind, whatever
   the corpus) estimates how far each labeler can be trusted and how likely each pattern is right.
4. Those probabilities train a naive Bayes classifier on the span's kind, length, share of digits
   and context. Candidates it accepts are added to the base spans, which always stay.

Everything on the rows is built-in expressions; the driver sees only the two bounded count tables.

Defined results: null and empty texts have no spans; positions count code points of the whole
text, end exclusive; repeated rows are searched separately; of added spans that overlap the one that
starts first is kept, of equal starts the one of the kind listed first; extra columns are ignored or carried
on; an empty table gives an empty result. Repeated groups in the patterns are bounded or possessive, which
Java matches in a loop, so a run of many thousand digits, letters or labels doesn't overflow the stack.
Positions come from running sums in blocks (``scan``), so texts with very many matches take no quadratic time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, scan, stored, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "name", "national")

#: (kind, pattern, what a text must match for the pattern to be tried). A match of e-mail or address can only begin
#: where a run of its first class begins or where the match before ended; card matches whole digit groups only.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
WIDE = (
    ("email", r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}){1,4}", r"[(\[]at[)\]]"),
    ("phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", r"[0-9]{3}[ .-][0-9]{4}"),
    ("secret", r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?[A-Za-z0-9/+_-]{12,}+[\"']?", r"(?i)(?:token|secret|password|passwd|api[_-]?key)[ \t]{0,3}[=:]"),
    ("name", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?", r"(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z]"),
    ("national", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
)

#: Fixed values of the gazetteer and context labelers.
CONTEXT = r"(?i)(?:e-?mail|mail|phone|tel|mobile|call|fax|card|visa|iban|address|host|server|contact|token|secret|password|passwd|api|ssn|name)[^\n]{0,16}$"
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0+\.|255\.)",
    "card": r"^[3-6]",
    "phone": r"^\+?\(?[0-9]",
    "secret": r"(?i)^(?:token|secret|password|passwd|api)",
    "name": r"(?i) (?:James|John|Mary|Anna|Peter|Maria|Jean|Marie|Hans|Carlos|David|Laura|Paul|Julia|Michael|Sarah)",
    "national": r"^(?!000|666|9)",
}

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
#: Code points in a run of ``redact``; a place beyond every text.
RUN, NOWHERE = 1024, (1 << 31) - 1
CAND = "array<struct<start:int,rank:int,kind:string,end:int,base:boolean,votes:string,traits:array<string>>>"


def luhn(number: Column) -> Column:
    """Whether the digits of ``number`` pass the check sum."""
    digits = F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), "")
    doubled = F.transform(
        F.filter(digits, lambda x: x != ""),
        lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + (x.cast("int") * 2 / 10).cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0


def digits_in(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def base_ok(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(m, F.lit(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"))
    if kind == "card":
        return luhn(m)
    if kind == "phone":
        return digits_in(m).between(10, 15)
    return F.lit(True)


def votes(kind: str, m: Column, left: Column, right: Column, base: Column) -> Column:
    """The five votes as text, such as '+0+-+'."""
    sign = lambda yes, otherwise: F.when(yes, "+").otherwise(otherwise)
    variety = F.size(F.array_distinct(F.split(F.regexp_replace(m, "[^A-Za-z0-9]", ""), "")))
    clean = ~F.regexp_like(F.coalesce(F.right(left, F.lit(1)), F.lit("")), F.lit("[A-Za-z0-9]")) & ~F.regexp_like(
        F.coalesce(F.left(right, F.lit(1)), F.lit("")), F.lit("[A-Za-z0-9]")
    )
    return F.concat(
        sign(base, "0"),
        sign(variety >= 5, "-"),
        sign(F.regexp_like(left, F.lit(CONTEXT)), "0"),
        sign(F.regexp_like(m, F.lit(GAZETTEER[kind])), "-"),
        sign(clean, "-"),
    )


def traits(kind: str, m: Column, left: Column) -> Column:
    """What the final classifier sees: kind, length, share of digits, context."""
    size = F.length(m)
    return F.array(
        F.lit(f"kind={kind}"),
        F.concat(F.lit(f"{kind} length="), F.least(F.floor(size / 8), F.lit(7)).cast("string")),
        F.concat(F.lit(f"{kind} digits="), F.floor(F.lit(4.0) * digits_in(m) / size).cast("string")),
        F.concat(F.lit("context="), F.regexp_like(left, F.lit(CONTEXT)).cast("string")),
    )


def found(text: Column, kind: str, pattern: str, base: bool, when: Column) -> Column:
    """Candidates of one pattern, in order. Splitting at the matches gives the lengths between them."""
    rank = KINDS.index(kind)

    def span(m: Column, before: Column, after: Column, end: Column) -> Column:
        left = F.right(before, F.lit(24))

        def judged(ok: Column) -> Column:
            return F.struct(
                (end - F.length(m)).alias("start"),
                F.lit(rank).alias("rank"),
                F.lit(kind).alias("kind"),
                end.alias("end"),
                ok.alias("base"),
                votes(kind, m, left, after, ok).alias("votes"),
                traits(kind, m, left).alias("traits"),
            )

        return bind(base_ok(kind, m), judged) if base else judged(F.lit(False))

    def located(hits: Column, parts: Column) -> Column:
        steps = F.transform(hits, lambda m, i: F.length(F.get(parts, i)) + F.length(m))
        return bind(scan(steps, 0, lambda at, x: at + x), lambda ends: F.transform(hits, lambda m, i: span(m, F.get(parts, i), F.get(parts, i + 1), F.get(ends, i))))

    every = bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: bind(F.split(text, pattern, -1), lambda parts: located(hits, parts)))
    return F.when(when, every.cast(CAND)).otherwise(F.array().cast(CAND))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_cands``: candidate spans of every kind, base kinds first; not yet judged."""
    df = docs.withColumn("_body", F.coalesce(F.col(text), F.lit("")))
    body = F.col("_body")
    arrays = [
        found(body, "email", EMAIL, True, F.contains(body, F.lit("@"))),
        found(body, "ip", IP, True, F.regexp_like(body, F.lit(r"[0-9]\.[0-9]"))),
        found(body, "card", CARD, True, F.regexp_like(body, F.lit(r"[0-9](?:[ -]?[0-9]){13}"))),
        found(body, "phone", PHONE, True, F.regexp_like(body, F.lit(r"\+[0-9]"))),
    ] + [found(body, kind, pattern, False, F.regexp_like(body, F.lit(need))) for kind, pattern, need in WIDE]
    return df.withColumn("_cands", F.concat(*arrays)).drop("_body")


def reliabilities(counts: dict[str, float], rounds: int = 60) -> dict[str, float]:
    """Probability that a candidate with a vote pattern is right, by expectation-maximisation.

    ``counts`` maps 'kind|votes' to how many candidates voted so; the latent class is binary and the
    labelers are taken as independent given the class. Starts from the majority.
    """
    right = {k: min(0.95, max(0.05, 0.5 + 0.15 * (v := k.split("|")[1]).count("+") - 0.25 * v.count("-"))) for k in counts}
    total = sum(counts.values())
    for _ in range(rounds if total else 0):
        mass = sum(n * right[k] for k, n in counts.items())
        prior = (mass + 1) / (total + 2)
        chance: dict[tuple[int, str, bool], float] = {}
        for i in range(5):
            for vote in "+0-":
                yes = sum(n * right[k] for k, n in counts.items() if k.split("|")[1][i] == vote)
                no = sum(n * (1 - right[k]) for k, n in counts.items() if k.split("|")[1][i] == vote)
                # the labelers lean right: weak prior counts keep the two classes from changing places
                chance[i, vote, True] = (yes + (4 if vote == "+" else 1)) / (mass + 6)
                chance[i, vote, False] = (no + (4 if vote == "-" else 1)) / (total - mass + 6)
        for k in counts:
            odds = math.log(prior / (1 - prior)) + sum(
                math.log(chance[i, v, True] / chance[i, v, False]) for i, v in enumerate(k.split("|")[1])
            )
            right[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return right


def train(judged: DataFrame) -> tuple[float, dict[str, float]]:
    """(bias, weights by trait) of the span classifier from candidates with votes; both tables read are bounded."""
    each = judged.select(F.explode("_cands").alias("c")).select(F.concat_ws("|", "c.kind", "c.votes").alias("pattern"), "c.traits")
    table_ = each.groupBy("pattern", "traits").count().collect()
    counts: dict[str, float] = {}
    for r in table_:
        counts[r["pattern"]] = counts.get(r["pattern"], 0) + r["count"]
    right = reliabilities(counts)
    yes = no = 1.0
    seen: dict[str, list[float]] = {}
    for r in table_:
        p, n = right[r["pattern"]], r["count"]
        yes, no = yes + p * n, no + (1 - p) * n
        for t in r["traits"]:
            s = seen.setdefault(t, [0.0, 0.0])
            s[0], s[1] = s[0] + p * n, s[1] + (1 - p) * n
    weights = {t: math.log((a + 0.5) / (yes + 1)) - math.log((b + 0.5) / (no + 1)) for t, (a, b) in seen.items()}
    return math.log(yes / no), weights


def find_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """Columns ``keep`` with ``base`` (strict spans) and ``spans`` (those and accepted ones), ordered by start and kind."""
    rows = stored(candidates(docs, text).select(*keep, "_cands"), "pii")
    bias, weights = train(rows)
    known = F.create_map(*[x for kv in weights.items() for x in (F.lit(kv[0]), F.lit(float(kv[1])))]) if weights else F.lit(None).cast("map<string,double>")
    score = lambda c: F.aggregate(c["traits"], F.lit(float(bias)), lambda s, t: s + F.coalesce(F.try_element_at(known, t), F.lit(0.0)))
    as_span = lambda a: F.transform(a, lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["kind"].alias("kind"), c["end"].alias("end"))).cast(SPAN)
    base = F.sort_array(as_span(F.filter("_cands", lambda c: c["base"])))
    logit = math.log(threshold / (1 - threshold))
    extra = F.sort_array(as_span(F.filter("_cands", lambda c: ~c["base"] & (score(c) >= logit))))
    spans = F.when(F.size("_extra") > 0, F.sort_array(F.concat("_base", added(F.col("_base"), F.col("_extra"))))).otherwise(F.col("_base"))
    return (
        rows.withColumns({"_base": base, "_extra": F.when(F.size("_cands") > 0, extra).otherwise(F.array().cast(SPAN))})
        .select(*keep, F.col("_base").alias("base"), spans.alias("spans"))
    )


def added(base: Column, extra: Column) -> Column:
    """The spans of ``extra`` that overlap no base span and no kept one before them. Both are sorted."""
    marked = F.concat(F.transform(base, lambda x: F.struct(*_fields(x), F.lit(True).alias("fixed"))), F.transform(extra, lambda x: F.struct(*_fields(x), F.lit(False).alias("fixed"))))

    def free(every: Column) -> Column:
        reach = scan(every, 0, lambda to, x: F.greatest(to, F.when(x["fixed"], x["end"]).otherwise(0)))  # how far base spans up to each reach
        nearest = scan(F.reverse(every), NOWHERE, lambda at, x: F.when(x["fixed"], x["start"]).otherwise(at))  # start of the next base span
        last = F.size(every) - 1
        clear = lambda r, n: F.filter(every, lambda x, i: ~x["fixed"] & (F.get(r, i) <= x["start"]) & (F.get(n, last - i) >= x["end"]))
        return bind(reach, lambda r: bind(nearest, lambda n: clear(r, n)))

    def first(clear: Column) -> Column:
        reach = scan(clear, 0, lambda to, x: F.when(x["start"] >= to, x["end"]).otherwise(to))
        kept = lambda r: F.filter(clear, lambda x, i: (i == 0) | (x["start"] >= F.get(r, F.greatest(i - 1, F.lit(0)))))
        return bind(reach, kept)

    return F.transform(bind(bind(F.sort_array(marked), free), first), lambda x: F.struct(*_fields(x))).cast(SPAN)


def _fields(x: Column) -> list[Column]:
    return [x[f].alias(f) for f in ("start", "rank", "kind", "end")]


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first one holds.

    The text is cut once into runs of ``RUN`` code points, so that no span is sought from the text's beginning.
    """

    def between(runs: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / RUN).cast("int")
        some = F.array_join(F.slice(runs, first + 1, F.floor(b / RUN).cast("int") - first + 1), "")
        return F.substring(some, a - first * RUN + 1, b - a)

    def joined(runs: Column, reach: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(reach, F.greatest(i - 1, F.lit(0)))).otherwise(0)
        label = lambda x: F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))
        part = lambda x, i: F.when(x["start"] >= before(i), F.concat(between(runs, before(i), x["start"]), label(x))).otherwise("")
        end = F.element_at(reach, -1)
        return F.concat(F.array_join(F.transform(spans, part), ""), between(runs, end, F.greatest(end, F.length(text))))

    runs = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{RUN}}}"), F.lit(0))
    reach = scan(spans, 0, lambda to, x: F.greatest(to, x["end"]))
    return F.when(F.size(spans) > 0, bind(runs, lambda r: bind(reach, lambda e: joined(r, e)))).otherwise(text)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in BASE]
    return rows.select(
        "doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
