"""Operators of the corpus preparation subpackage against plain Python, and on awkward rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm.op1_quality_rules import SQL, judge, op1_quality_rules
from marlstone.llm.op2_jaccard_join import op2_jaccard_join, similar_classes
from marlstone.llm.op3_decontaminate import contamination, op3_decontaminate
from marlstone.llm.op4_sharding import op4_sharding, shuffled
from marlstone.llm.op5_training_order import feistel, materialise, op5_training_order, read_slots
from marlstone.llm.op6_language import classify, fit, op6_language
from marlstone.llm.op7_licenses import license_matches, op7_licenses
from marlstone.llm.op8_packing import op8_packing, pack
from marlstone.llm.op9_toxicity import fit as fit_toxicity
from marlstone.llm.op9_toxicity import op9_toxicity, score
from marlstone.llm.op10_pii import find_spans, listed, op10_pii, redact

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, row string, term string, shard int"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977} the" for i in range(20_000))
    texts = [None, "", "  \n\t", "one two", "same text of five words here", "same text of five words here", long, "x" * 20_000, "1" * 9_000, "Released under the MIT License. a@b.co"]
    rows = [(i, t, "en" if i % 2 else None, "s", 0, 1, "r", "t", 9) for i, t in enumerate(texts)]
    rows += [rows[4], (None, "no key at all in this row", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "same text of five words here", 3), (2, None, 3), (3, "", 3), (1, "same text of five words here", 3)], "item_id long, text string, row int")


def test_quality_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    a = op1_quality_rules(spark, sf_dir).toPandas()
    b = con.execute(SQL).df()[a.columns]
    assert a.sort_values("doc_id").values.tolist() == b.sort_values("doc_id").values.tolist()


def test_quality_odd(odd, none):
    rows = {r["doc_id"]: r for r in judge(odd).collect()}
    assert rows[0]["n_words"] == rows[1]["n_words"] == rows[2]["n_words"] == 0 and rows[0]["base_failed"]
    assert rows[6]["n_words"] == 40_000 and rows[6]["base_failed"] and judge(none).count() == 0


def test_join(spark, sf_dir, docs):
    sets = {}
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    by = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            by[g].append(d)
    both = collections.Counter((a, b) for ds in by.values() for j, b in enumerate(ds) for a in ds[:j])
    links = [(a, b) for (a, b), c in both.items() if c / (len(sets[a]) + len(sets[b]) - c) >= 0.8]
    root = {d: d for d in sets}
    for _ in range(len(sets)):
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
        if not changed:
            break
    n = collections.Counter(x for ab in links for x in ab)
    for r in op2_jaccard_join(spark, sf_dir).collect():
        assert (r["class_id"], r["n_links"]) == (root[r["doc_id"]], n[r["doc_id"]])


def test_join_odd(odd, none):
    rows = [r for r in similar_classes(odd).collect()]
    of = lambda i: [r for r in rows if r["doc_id"] == i]
    assert len(rows) == 12 and of(0)[0]["class_id"] == 0 and of(0)[0]["n_links"] == 0
    assert {r["class_id"] for r in of(4) + of(5)} == {4} and of(5)[0]["n_links"] == 2
    assert similar_classes(none).count() == 0


def test_join_of_repeated_and_missing_keys(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (None, "one two three"), (None, "one  two three"), (None, "other")], "doc_id long, text string")
    got = sorted(similar_classes(rows).collect(), key=lambda r: r["_row"])
    assert [r["n_links"] for r in got] == [1, 1, 1, 1, 1, 1, 0]
    assert [r["class_id"] for r in got[:4]] == [1, 1, 1, 1] and [r["is_first"] for r in got] == [True, True, False, False, True, False, True]
    assert got[4]["class_id"] == got[5]["class_id"] < 0 and got[6]["class_id"] not in (got[5]["class_id"], 1)
    assert [r["n_copies"] for r in got] == [1, 1, 1, 1, 2, 2, 1]


def test_join_splits_large_buckets_until_small(spark, monkeypatch):
    from marlstone.llm import op2_jaccard_join as op2

    monkeypatch.setattr(op2, "LIMIT", 4)
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 40)]
    mixed = [[f"v{x}" for x in rng.integers(0, 10**6, 40)] for _ in range(30)]
    texts = [" ".join(base + [f"u{i}"]) for i in range(40)] + [" ".join(base[:20] + m) for m in mixed] + [" ".join([*m, "z"]) for m in mixed] + [" ".join(m) for m in mixed]
    got = {r["doc_id"]: r for r in similar_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    for i, s in enumerate(sets):
        assert got[i]["n_links"] == sum(len(s & t) >= 0.8 * len(s | t) for t in sets) - 1, i


def test_decontamination(spark, sf_dir, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = cut(r["text"])
        for k in range(max(1, len(w) - 9)) if w else []:
            windows[tuple(w[k : k + 10])].add(r["item_id"])
    sizes, texts, found = {len(x) for x in windows}, dict(zip(docs.doc_id, docs.text, strict=True)), 0
    for r in op3_decontaminate(spark, sf_dir).collect():
        w, hit, items = cut(texts[r["doc_id"]]), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    items |= windows[g]
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        found += bool(hit)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(items), digest, bool(hit))
    assert found


def test_decontamination_odd(odd, none, bench):
    rows = contamination(odd, bench).collect()
    assert len(rows) == 12 and sorted(str(r["doc_id"]) for r in rows if r["contaminated"]) == ["4", "4", "5"]
    assert contamination(none, bench).count() == 0 and contamination(odd, bench.where("false")).where("contaminated").count() == 0


def test_decontamination_without_ids_and_without_broadcasts(spark, monkeypatch):
    from marlstone.llm import common

    passage = " ".join(f"p{i}" for i in range(14))
    items = spark.createDataFrame([(None, passage), (5, passage + " tail"), (6, "of the")], "item_id long, text string")
    texts = [passage, "x " + passage.upper() + " tail y", "of the", "P3 p4", None, " ".join(f"p{i} gap" if i == 7 else f"p{i}" for i in range(14))]
    rows = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)] + [(None, passage)], "doc_id long, text string")
    read = lambda: sorted(contamination(rows, items).collect(), key=lambda r: r["_row"])
    got = read()
    assert sorted((r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got) == sorted(
        [(14, 14, ("", "5"), True)] * 2 + [(17, 15, ("", "5"), True), (2, 2, ("6",), True), (2, 0, (), False), (0, 0, (), False), (15, 0, (), False)]
    )
    assert [r["n_near"] for r in got if r["n_words"] == 15] == [2]
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert read() == got
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_decontamination_of_repeated_words(spark):
    """Runs of one word, alternating words and other windows of an item against long texts of the same words, by brute force."""
    items = {1: ["the"] * 200, 2: ["the", "cat"] * 60, 3: ["the"] * 12 + ["end"] + ["the"] * 12, 4: ["cat"] * 4}
    texts = [["the"] * 40_000, ["the"] * 9, ["x"] + ["the", "cat"] * 3_000 + ["y"], ["the"] * 30 + ["end"] + ["the"] * 7, ["cat"] * 5 + ["the"] * 10, []]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, w in items.items():
        for k in range(max(1, len(w) - 9)):
            windows[tuple(w[k : k + 10])].add(i)
    got = {r["doc_id"]: r for r in contamination(rows, bench).collect()}
    for i, w in enumerate(texts):
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[g]
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(map(str, found)))


def test_sharding(spark, sf_dir, docs):
    p = op4_sharding(spark, sf_dir).toPandas().merge(docs[["doc_id", "text"]])
    sizes = p.groupby("shard").slot.apply(list)
    assert len(p) == len(docs) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes)
    assert all(zlib.crc32(t.encode()) == c and len(t.encode()) + 1 == s for t, c, s in zip(p.text, p.text_crc32, p["size"], strict=True))


def test_sharding_odd(odd, none):
    rows = shuffled(odd).collect()
    assert len(rows) == 12 and sorted(r["shard"] for r in rows) == list(range(12)) and shuffled(none).count() == 0


def test_sharding_keeps_keys_and_repeats(spark):
    keys = [2**60 + 1, None, 2**60 + 3, None, 5, 5, 5]
    rows = spark.createDataFrame([(k, f"t{i}", None if i % 2 else 2**60 + i) for i, k in enumerate(keys)], "doc_id long, text string, n long")
    one = shuffled(rows, shards=2, buckets=1).collect()
    assert sorted((r["text"], r["doc_id"], r["n"]) for r in one) == sorted(tuple(r)[1::-1] + (r["n"],) for r in rows.collect())
    # the order by hand: hash of the key, then place; then the seeded Fisher-Yates shuffle
    ordered = [r["text"] for r in rows.withColumn("_row", F.monotonically_increasing_id()).orderBy(F.xxhash64("doc_id"), "_row").collect()]
    place = np.random.Generator(np.random.PCG64([17, 0])).permutation(7)
    assert {(r["text"], r["shard"], r["slot"]) for r in one} == {(t, p % 2, p // 2) for t, p in zip(ordered, place.tolist(), strict=True)}
    assert sorted(shuffled(rows, buckets=3).collect(), key=str) == sorted(shuffled(rows, buckets=3).collect(), key=str)


def test_orders_do_not_depend_on_splits(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    source.repartition(3, "doc_id").write.option("parquet.block.size", 20_000).option("parquet.page.size", 2_000).parquet(f"{tmp_path}/d")
    made = []
    try:
        for size in (4 << 20, 15_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = spark.read.parquet(f"{tmp_path}/d")
            sharded = shuffled(rows, buckets=5, fixed=True).select("doc_id", "shard", "slot").collect()
            order = read_slots(materialise(rows, f"{tmp_path}/o{size}", fixed=True)).select("slot", "doc_id", "start", F.crc32("ids")).collect()
            made.append((rows.rdd.getNumPartitions(), sorted(map(tuple, sharded)), sorted(map(tuple, order))))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert made[1][0] > made[0][0] and made[0][1:] == made[1][1:]


def test_sharding_spreads_a_repeated_key(spark):
    rows = spark.createDataFrame([(7, "same")] * 2000, "doc_id long, text string")
    got = shuffled(rows, shards=4, buckets=8).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert all((r["n"], r["d"], r["m"]) == (500, 500, 499) for r in got) and len(got) == 4


def test_order(spark, sf_dir, docs, odd, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    for n in (1, 2, 7, 1000):
        assert sorted(feistel(np.arange(n), n, 5)) == list(range(n))
    p = op5_training_order(spark, sf_dir).toPandas()
    assert sorted(p.slot) == list(range(len(p)))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, x in zip(docs.doc_id, t.encode_batch(list(docs.text), add_special_tokens=False), strict=True):
        ids = np.array([*x.ids, 0], "<u2")
        want |= {(d, a): (len(c := ids[a : a + 1024]), zlib.crc32(c.tobytes())) for a in range(0, len(ids), 1024)}
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32) for r in p.itertuples()} == want and len(p) == len(want)
    blocks = materialise(odd, f"{tmp_path}/a")
    whole = read_slots(blocks).count()
    assert whole == read_slots(blocks, 0, 5).count() + read_slots(blocks, 5).count() and materialise(none, f"{tmp_path}/b").count() == 0
    # the order by hand: ordinals follow the places, and the slots follow from the ordinals
    one = spark.createDataFrame([(i, "word") for i in range(100)] + [(None, None)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["slot"] for r in read_slots(materialise(one, f"{tmp_path}/c", key=9)).collect()}
    assert got == dict(zip([*range(100), None], feistel(np.arange(101), 101, 9).tolist(), strict=True))


def test_order_resumes_at_a_shard(spark, tmp_path, monkeypatch):
    from marlstone.llm import op5_training_order as op5

    monkeypatch.setattr(op5, "PER_BLOCK", 4)
    monkeypatch.setattr(op5, "PER_SHARD", 8)
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    blocks = materialise(rows, f"{tmp_path}/a")
    assert len({f.split("/shard=")[1] for f in blocks.inputFiles()}) == 4  # one file for each range
    parts = blocks.select("shard", "block", "n").orderBy("block").collect()
    assert [tuple(r) for r in parts] == [(b // 2, b, 4 if b < 7 else 2) for b in range(8)]
    late = read_slots(blocks, 17, 26)
    assert "PartitionFilters: [isnotnull(shard" in late._jdf.queryExecution().toString() and sorted(r["slot"] for r in late.collect()) == list(range(17, 26))


def test_language(spark, sf_dir, docs, odd, none):
    p = op6_language(spark, sf_dir).toPandas().merge(docs[["doc_id", "lang"]])
    held = p[p.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and p.score.between(0, 1).all()
    model = fit(odd)
    got = {r["doc_id"]: r["lang_pred"] for r in classify(odd, model).collect()}
    assert got[0] == got[1] == got[2] == got[8] == "und" and got[3] == "en"
    assert classify(none, model).count() == 0 and fit(none)[0] == []


def test_language_sample_leaves_held_out_rows_out(spark):
    from marlstone.llm.op6_language import PER_LANGUAGE, SAMPLE, labelled_sample

    crc = lambda i: zlib.crc32(str(i).encode()) % 5
    held = [i for i in range(40_000) if crc(i) == 0][:3000]
    rows = [(i, f"text number {i}", "aa") for i in range(6000) if crc(i)] + [(i, "held out text", "zz") for i in held]
    rows += [(50_000 + i, f"rare {i}", f"l{i % 3}") for i in range(90)] + [(None, "no key", "nn"), (7, "x", None)]
    got = labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas()
    n = got.lang.value_counts()
    assert "zz" not in n and "nn" not in n and SAMPLE - 90 <= n["aa"] <= SAMPLE + PER_LANGUAGE and not got.doc_id.duplicated().any()
    assert all(n[f"l{k}"] == sum(crc(50_000 + i) != 0 for i in range(k, 90, 3)) for k in range(3))


def brute_licenses(texts):
    """license_matches by plain Python: every window of every text against every template."""
    import math

    import regex
    from marlstone.llm.op7_licenses import CONTAINED, TEMPLATES

    cut = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    grams = lambda w: [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    known = [(name, set(grams(w := cut(t))), 2 ** math.ceil(math.log2(max(4, len(w))))) for name, t in TEMPLATES]
    out = {}
    for d, t in texts:
        g = grams(cut(t))
        for name, wanted, reach in known:
            for at in range(0, len(g), reach):
                share = len(wanted & set(g[at : at + 2 * reach - 2])) / len(wanted)
                if share >= CONTAINED:
                    ats, most = out.setdefault((d, name), (set(), []))
                    ats.add(at)
                    most.append(share)
    return {k: (len(a), min(a), max(m)) for k, (a, m) in out.items()}


def test_licenses(spark, sf_dir, docs, odd, none):
    got = {(r["doc_id"], r["license"]): (r["n_windows"], r["first_word"], r["containment"]) for r in op7_licenses(spark, sf_dir).collect()}
    assert got and got == brute_licenses(zip(docs.doc_id, docs.text, strict=True))
    assert [(r["doc_id"], r["license"]) for r in license_matches(odd).collect()] == [(9, "mit")] and license_matches(none).count() == 0


def test_licenses_whole_bodies(spark):
    from marlstone.llm.op7_licenses import TEMPLATES

    filler = " ".join(f"word{i}" for i in range(173))
    texts = [(i, f"{filler} {t.upper() if i % 2 else t} {filler}") for i, (_, t) in enumerate(TEMPLATES)]
    # some words changed, the body cut in half, and every template in one long text
    texts += [(100 + i, " ".join("changed" if k % 40 == 7 else w for k, w in enumerate(t.split()))) for i, (_, t) in enumerate(TEMPLATES)]
    texts += [(200 + i, " ".join(t.split()[: len(t.split()) // 2])) for i, (_, t) in enumerate(TEMPLATES)]
    texts += [(300, f" {filler} ".join(t for _, t in TEMPLATES)), (None, "Released under the MIT License."), (None, "Released under the MIT License.")]
    rows = license_matches(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["license"]): (r["n_windows"], r["first_word"], r["containment"]) for r in rows}
    assert got == brute_licenses(texts) and [r["doc_id"] for r in rows].count(None) == 2
    assert all((i, name) in got for i, (name, _) in enumerate(TEMPLATES))


def test_packing(spark, sf_dir, docs, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array(x.ids + [0], "<u4") for d, x in zip(docs.doc_id, t.encode_batch(list(docs.text), add_special_tokens=False), strict=True)}
    p = op8_packing(spark, sf_dir).toPandas()
    for d, g in p.sort_values(["doc_id", "start"]).groupby("doc_id"):
        at = 0
        for r in g.itertuples():
            assert r.start == at and zlib.crc32(ids[d][at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[d])
    for _, g in p.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 1024
    rows = pack(odd).toPandas()
    assert rows.length.sum() == rows.drop_duplicates(["doc_id", "doc_tokens"]).doc_tokens.sum() + 7 and pack(none).count() == 0


def test_toxicity(spark, sf_dir, odd, none):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    p = op9_toxicity(spark, sf_dir).toPandas()
    assert p.score.between(0, 1).all() and ((p.score >= 0.7) == (p.predicted == 1)).all()
    toy = spark.createDataFrame([(i, ("you vile person " if i % 2 else "a kind person ") + f"n{i}") for i in range(300)], "doc_id long, text string")
    model = fit_toxicity(toy, toy.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    got = {r["doc_id"]: r["predicted"] for r in score(toy, model).collect()}
    assert all(got[i] == i % 2 for i in got)
    assert score(odd, model).count() == 12 and score(none, model).count() == 0
    assert {r["score"] for r in score(odd, fit_toxicity(odd, labels.where("false"))).collect()} == {0.0}


def test_pii(spark, sf_dir, docs, odd, none):
    def luhn(s):
        return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(s)))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]

    def base(t):
        found = [(m.start(), k, n, m.end()) for k, (n, r, ok) in enumerate(kinds) for m in re.finditer(r, t) if ok(m.group())]
        return ",".join(f"{n}:{a}:{b}" for a, k, n, b in sorted(found))

    tricky = [
        "a@b.c_d@e.fg x@y @z.q a.b@c", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112222",
        "+1 (555) 555-0100, +12 +1  2 +1234567890123456", "é+49 30 1234567 ñ mail: ö@x.de o@x.de", "4111  1111 1111 1111", "5 4111111111111111 7",
    ]
    small = spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string")
    for r in find_spans(small, keep=("doc_id", "text")).select("doc_id", "text", listed(F.col("base")).alias("b")).collect():
        assert r["b"] == base(r["text"]), r
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    for r in op10_pii(spark, sf_dir).collect():
        assert r["base_sha256"] == hashlib.sha256(base(texts[r["doc_id"]]).encode()).hexdigest()
        assert set(filter(None, base(texts[r["doc_id"]]).split(","))) <= set(r["spans"].split(","))
    rows = find_spans(odd, keep=("doc_id", "text"))
    got = {r["doc_id"]: r["t"] for r in rows.select("doc_id", redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got[9] == "Released under the MIT License. [EMAIL]" and got[0] is None and find_spans(none).count() == 0


def test_pipeline(spark, sf_dir, odd, none, docs, tmp_path):
    import corpus_pipeline as cp

    out = cp.run(spark, sf_dir).toPandas()
    assert 0.7 * len(docs) < out.doc_id.nunique() < len(docs)
    for i, rows in enumerate((odd, none)):
        for name, stage in cp.STAGES:
            stage(spark, rows, sf_dir).write.parquet(f"{tmp_path}/{i}{name}")
            rows = spark.read.parquet(f"{tmp_path}/{i}{name}")
            assert name == "packing" or tuple(rows.columns) == cp.COLUMNS, name


def test_pipeline_stages_against_plain_python(spark, sf_dir, docs, tmp_path):
    """Near copies and contaminated rows of the whole table, by brute force; rows without keys included."""
    import corpus_pipeline as cp

    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a  b c d e f"), (2, "g h i j k l"), (None, item), (None, None)]
    spark.createDataFrame([(k, t, None, None, None) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/rows")
    odd = spark.read.parquet(f"{tmp_path}/rows")
    stages = dict(cp.STAGES)
    assert [(r["doc_id"], r["text"]) for r in stages["jaccard_join"](spark, odd, sf_dir).collect()].count((1, "a b c d e f")) == 1
    assert stages["jaccard_join"](spark, odd, sf_dir).count() == 4
    left = stages["decontamination"](spark, odd, sf_dir).collect()
    assert len(left) == 5 and item not in [r["text"] for r in left]


def test_nearest_examples_equal_brute_force():
    from marlstone.llm.op9_toxicity import BLOCK, FIRST, NEIGHBOURS, Index, Vocabulary

    rng = np.random.default_rng(1)
    words = Vocabulary({f"w{i}": i for i in range(200)}, np.concatenate([rng.uniform(0.5, 3, 190), np.full(10, 40.0)]))
    counts = [{f"w{t}": int(rng.integers(1, 4)) for t in [0, *rng.integers(3, 200, rng.integers(0, 12))][k % 5 > 0 :]} for k in range(1000)]
    counts += counts[:50]
    vectors = [words.vector(x) for x in counts]
    whole = np.zeros((len(counts), 200))
    for row, (at, w) in zip(whole, vectors, strict=True):
        row[at] = w
    index, skipped = Index(vectors, 200), 0
    read = index.read
    assert 0 < len(index.dense) < 200
    for k in range(0, 1050, 7):
        blocks = set()
        index.read = lambda *x: blocks.update(np.flatnonzero(x[-1]).tolist()) or read(*x)  # noqa: B023
        cosines = np.round(whole @ whole[k], 9)
        cosines[k] = 0
        want = [(cosines[i], i) for i in np.lexsort((np.arange(1050), -cosines))[:NEIGHBOURS] if cosines[i] > 0]
        got = index.nearest([vectors[k]], range(k, k + 1))[0]
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [s for s, _ in want])
        skipped += len(blocks) < index.blocks
    assert skipped > 50 and index.blocks == -(-1050 // BLOCK) > FIRST
    assert Index([], 3).nearest([words.vector({})]) == [[]]


def test_toxicity_scores_by_neighbours_over_all_terms(spark, sf_dir, docs):
    from marlstone.llm.op9_toxicity import NEIGHBOURS, document_frequencies, term_counts

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(rows, labels)
    p = score(rows, model).toPandas()
    empty = {d for d, t in zip(docs.doc_id, docs.text, strict=True) if not term_counts(t)}
    assert p[~p.doc_id.isin(empty)].evidence.notna().mean() > 0.95
    texts, words = dict(zip(docs.doc_id, docs.text, strict=True)), model.vocabulary
    n, df = document_frequencies(rows, words.places)
    assert n == len(docs) and all(df[words.places[t]] == sum(t in term_counts(x) for x in docs.text) for t in list(words.places)[::997])
    vectors = [dict(zip(*words.vector(term_counts(texts[k])), strict=True)) for k in model.keys]
    for d, text in list(texts.items())[::9]:
        q = dict(zip(*words.vector(term_counts(text)), strict=True))
        every = sorted(((round(sum(w * v.get(t, 0.0) for t, w in q.items()), 9), -i) for i, v in enumerate(vectors)), reverse=True)
        near = [(s, -i) for s, i in every[:NEIGHBOURS] if s > 0]
        assert [i for _, i in model.index.nearest([words.vector(term_counts(text))])[0]] == [i for _, i in near], d


def test_toxicity_of_conflicting_labels_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "same words", 5, 0.1), (2, "same words", 6, 0.2), (None, None, None, None), (4, "other thing", 7, 0.3)], "doc_id long, text string, toxic int, score double")
    labels = spark.createDataFrame([(i, y) for i in (1, 2, 4) for y in ((0, 1) if i < 4 else (0,))] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = sorted((r["doc_id"] or 0, r["score"]) for r in score(rows, fit_toxicity(rows, labels)).collect())
    assert len(got) == 4 and got[1][1] == got[2][1] and all(0 <= s <= 1 for _, s in got)


def test_packing_searches_all_tails_by_all_ids(spark):
    from marlstone.llm.op8_packing import Bm25, Stats, fill

    rare = np.arange(1000, 1030, dtype="<u2")
    texts = [np.concatenate([rare, [5]]).astype("<u2"), np.array([5, 6], "<u2"), np.array([7, 8], "<u2")]
    stats = Stats.of(texts * 20)
    assert Bm25(texts, stats).scores(texts[0])[1] > 0  # its only shared id is the least telling of 31
    assert np.isclose(stats.idf[5], np.log(1 + (60 - 40 + 0.5) / 40.5))
    many = [np.array([9, 9], "<u2"), *[np.array([10 + i, 1000], "<u2") for i in range(100)], *[np.array([9, 2000 + i], "<u2") for i in range(100)]]
    first = [i for i, _, _ in fill(many, 240)[0]]
    assert set(first[:101]) == {0, *range(101, 201)}  # beyond the best 64 as well

    topics = ["zebra quartz", "violin harbour", "cactus magnet", "walrus piston"]
    rows = [(i, f"{topics[i % 4]} {topics[i % 4]} n{i}") for i in range(400)]
    p = pack(spark.createDataFrame(rows, "doc_id long, text string"), window=64, shard_docs=100).toPandas()
    mixed = p.assign(topic=p.doc_id % 4).groupby("sequence_id").topic.nunique()
    assert (mixed > 1).mean() < 0.2 and p.length.sum() == p.drop_duplicates("doc_id").doc_tokens.sum()


def test_added_tokens_encode_as_in_the_json():
    import public_tokenizers
    from marlstone.llm.tokens import default_vocabulary, tokenizer
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for x in ("a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>  y\n<|endoftext|", "é \n\n<|endoftext|>\n", "<|ENDOFTEXT|> 's", "plain"):
        assert np.frombuffer(tokenizer(default_vocabulary()).ids(x), "<u2").tolist() == t.encode(x, add_special_tokens=False).ids


def test_texts_without_added_tokens_encode_without_looking_ahead():
    import itertools

    import public_tokenizers
    from marlstone.llm.tokens import Tokenizer, default_vocabulary
    from tokenizers import Tokenizer as Json

    t, own = Json.from_file(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer(default_vocabulary())
    whole, own.whole = own.whole, None  # the pattern that looks ahead: not called here
    bits = (" ", "\n", "\r\n", "\x1c", "\x85", "\xa0", "\u2003", "\u200b", "\u3000", "a", "7", "'s", ".")
    for x in map("".join, itertools.chain(itertools.product(bits, repeat=4), [("ab  c\n\n\nde \t ", "f" * 50, "  ")] * 2)):
        assert np.frombuffer(own.ids(x), "<u2").tolist() == t.encode(x, add_special_tokens=False).ids, x
        assert whole(x).tolist() == own.encode(x).tolist()
    assert own.ids("") == own.ids(None) == b""


def test_scan_equals_running_sums(spark):
    from marlstone.llm.common import SCAN_BLOCK, scan

    sizes = (0, 1, SCAN_BLOCK, SCAN_BLOCK + 1, 3 * SCAN_BLOCK)
    rows = spark.createDataFrame([(n, list(range(n))) for n in sizes], "n int, a array<int>")
    for r in rows.select("a", scan(F.col("a"), 5, lambda at, x: at + x).alias("s")).collect():
        assert r["s"] == [5 + sum(r["a"][: i + 1]) for i in range(len(r["a"]))]


def test_pii_in_texts_with_very_many_matches(spark):
    texts = [
        "x a@b" + ".c" * 30_000,
        " ".join(f"u{i}@ex.com" for i in range(20_000)),
        "1.2." * 10_000 + "1 " * 20_000 + "é\U0001f600 " * 3000,
        "call 555-123-4567 " * 4000 + "Dr. Anna Bell a@b.co \U0001f600 " * 2000,
    ]
    rows = find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep=("doc_id", "text"))
    got = rows.select("doc_id", "text", "base", "spans", redact(F.col("text"), F.col("spans")).alias("redacted")).collect()
    assert [len(r["base"]) for r in sorted(got)] == [1, 20_000, 5000, 2000]
    for r in got:
        out, at = [], 0
        for x in r["spans"]:
            if x["start"] >= at:
                out += [r["text"][at : x["start"]], f"[{x['kind'].upper()}]"]
            at = max(at, x["end"])
        assert r["redacted"] == "".join(out) + r["text"][at:]
        assert set(r["base"]) <= set(r["spans"])


def test_pii_added_spans_keep_clear_of_others(spark):
    from marlstone.llm.op10_pii import KINDS, SPAN, added

    rng = np.random.default_rng(4)
    make = lambda n: sorted({(int(a), int(k), KINDS[k], int(a + d)) for a, d, k in zip(rng.integers(0, 60, n), rng.integers(1, 6, n), rng.integers(0, 7, n), strict=True)})
    cases = [(i, make(i % 7), make(1 + i % 9)) for i in range(60)]
    for r in spark.createDataFrame(cases, f"i int, base {SPAN}, extra {SPAN}").select("base", "extra", added(F.col("base"), F.col("extra")).alias("a")).collect():
        want = []
        for x in r["extra"]:
            if not any(x["start"] < y["end"] and y["start"] < x["end"] for y in [*r["base"], *want]):
                want.append(x)
        assert r["a"] == want
