import collections
import random
import time
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.llm import neardup, shared


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


words = st.lists(st.integers(0, 12), max_size=25)


@settings(max_examples=400, deadline=None)
@given(words, words, st.integers(0, 12), st.integers(0, 3))
def test_alignment(a, b, most, similar):
    if similar:
        b = a[: len(a) // 2] + b[:2] + a[len(a) // 2 :]
    x, y = np.array(a, np.uint32), np.array(b, np.uint32)
    d = distance(a, b)
    assert neardup.banded_distance(x, y, most) == min(d, most + 1)
    assert neardup.edits_within(x, y, most) == (d <= most)


def test_alignment_of_long_texts():
    rng = np.random.default_rng(8)
    a = (rng.zipf(1.3, 100_000) % 50_000).astype(np.uint32)
    b, other = a.copy(), rng.permutation(a)
    b[rng.choice(len(a), 15_000, replace=False)] = 60_000
    b = np.delete(b, rng.choice(len(b), 4_000, replace=False))
    assert neardup.edits_within(a, b, 20_000) and not neardup.edits_within(a, b, 10_000) and not neardup.edits_within(a, other, 20_000)


def test_order_matters_to_sketches():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 2**63, 400, np.uint64)
    edited = text.copy()
    edited[[50, 300]] = 7
    halves = np.concatenate([text[200:], text[:200]])
    same = lambda a, b: int((neardup.sketches(a) == neardup.sketches(b)).sum())
    assert same(text, text) == neardup.SKETCHES
    assert same(text, edited) > same(text, halves) > 0  # nearly the same runs, in another order
    assert len(neardup.sketches(text[:0])) == 0 and len(neardup.sketches(text[:2])) == neardup.SKETCHES


def test_texts_at_the_threshold_share_a_sketch():
    rng, met = np.random.default_rng(4), 0
    for _ in range(300):
        a = rng.integers(0, 2**63, 150, np.uint64)
        b = a.copy()
        b[rng.choice(150, 30, replace=False)] = rng.integers(0, 2**63, 30, np.uint64)
        met += (neardup.sketches(a) == neardup.sketches(b)).any()
    assert met >= 297


def brute_classes(rows, threshold=0.8):
    """All pairs, by the plain distance."""
    texts = [(r["text"] or "").split() if r["text"] is not None else None for r in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = texts[i], texts[j]
            if a is None or b is None or top(i) == top(j):
                continue
            most = max(len(a), len(b))
            if rows[i]["text"] == rows[j]["text"] or most and min(len(a), len(b)) >= 0.8 * most and sum((collections.Counter(a) & collections.Counter(b)).values()) >= 0.8 * most and distance(a, b) <= (1 - threshold) * most + 1e-9:
                up[max(top(i), top(j))] = min(top(i), top(j))
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(i)
    out = []
    for members in groups.values():
        ids = [rows[i]["doc_id"] for i in members if rows[i]["doc_id"] is not None]
        out += [(rows[i]["doc_id"], min(ids) if ids else None) for i in members]
    return collections.Counter(out)


def test_classes_of_the_small_table(docs):
    rows = docs.where("n_chars < 4000").collect()
    found = neardup.classes(docs.where("n_chars < 4000"), "doc_id", "text").collect()
    assert collections.Counter((r["id"], r["class_id"]) for r in found) == brute_classes(rows)


def test_odd_rows(odd, empty):
    found = neardup.classes(odd, "doc_id", "text").collect()
    assert collections.Counter((r["id"], r["class_id"]) for r in found) == brute_classes(odd.collect())
    kept = neardup.one_of_each(odd, "doc_id", "text")
    assert kept.schema == odd.schema
    clash = odd.withColumns({c: F.lit("x") for c in ("_id", "_node", "node", "id", "root", "class_id", "row", "n", "of", "a.b")})
    assert neardup.one_of_each(clash, "doc_id", "text").schema == clash.schema and neardup.one_of_each(clash, "doc_id", "text").count() == kept.count()
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(["1", "2", "3", "None", "4", "5", "6", "7", "8"])  # the repeated row once
    assert neardup.classes(empty, "doc_id", "text").count() == 0 and neardup.one_of_each(empty, "doc_id", "text").count() == 0


def test_classes_of_one_id_are_told_apart(spark):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3])]
    kept = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted(r["text"] for r in kept) == texts


def test_a_large_group_of_near_copies(spark):
    rnd = random.Random(3)
    base, rows = [f"w{rnd.randrange(500)}" for _ in range(120)], []
    for i in range(600):
        text = list(base)
        for _ in range(3):
            text[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(f"y{rnd.randrange(10**6)}" for _ in range(100))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = neardup.classes(df, "doc_id", "text")
    assert {(r["id"], r["class_id"]) for r in found.collect()} == {(i, 0 if i < 600 else i) for i, _ in rows}
    assert sorted(r["doc_id"] for r in neardup.one_of_each(df, "doc_id", "text").collect()) == [0, *range(1000, 1050)]


def test_pairs_that_meet_only_in_a_common_passage(spark):
    rnd = random.Random(5)
    new = lambda n: [f"t{rnd.randrange(10**9)}" for _ in range(n)]
    passage, rows = new(60), []
    for i in range(40):
        tail = new(60)
        edited = [f"e{rnd.randrange(10**9)}" if k % 4 == 3 else w for k, w in enumerate(tail)]  # no five words in common
        rows += [(2 * i, " ".join(passage + tail)), (2 * i + 1, " ".join(passage + edited))]
    rows += [(100 + i, " ".join(passage + new(60))) for i in range(30)]
    found = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert {(r["id"], r["class_id"]) for r in found.collect()} == {(i, i - i % 2 if i < 100 else i) for i, _ in rows}


def test_components_of_a_chain(spark):
    n = 300
    order = random.Random(1).sample(range(n), n)
    node = lambda i: i.to_bytes(4, "big")
    edges = [(bytearray(node(a)), bytearray(node(b))) for a, b in zip(order, order[1:])] + [(bytearray(node(1000)), bytearray(node(1001)))]
    found = neardup.components(spark.createDataFrame(edges, "a binary, b binary")).collect()
    assert {(bytes(r["node"]), bytes(r["root"])) for r in found} == {(node(i), node(0)) for i in range(n)} | {(node(i), node(1000)) for i in (1000, 1001)}


def test_pipeline(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, counts = [n for n, _ in corpus_pipeline.STAGES], [docs.count()]
    assert names == ["quality_rules", "language_id", "near_dedup", "secret_scan", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[3] < counts[2] and counts[4] == counts[3]
    assert docs.where(F.col("text").contains("token = \"")).count() == 0
    assert docs.where("n_chars != char_length(text)").count() == 0
    packed = corpus_pipeline.run(spark, small)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_pipeline_stages_take_odd_tables(spark, small, odd, empty):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    clash = odd.withColumns({c: F.lit("x") for c in ("_length", "length", "row", "_doc", "_text", "node", "id", "stratum", "spans")})
    for df in (odd, empty, clash):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, small).columns == df.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, df, small).count() >= df.count()


@pytest.mark.parametrize("block", [2048, 16])
def test_all_pairs_of_a_bucket_are_compared(spark, monkeypatch, block):
    """Near copies that no hub is like, with no two words running in common outside the passage that all have."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rnd = random.Random(7)
    new = lambda n: [f"t{rnd.randrange(10**9)}" for _ in range(n)]
    passage, rows = new(60), []
    for i in range(60):
        tail = new(40)
        edited = [f"e{rnd.randrange(10**9)}" if k % 2 else w for k, w in enumerate(tail)]  # 20 edits of 100 words
        rows += [(2 * i, " ".join(passage + tail)), (2 * i + 1, " ".join(passage + edited))]
    rows += [(200 + i, " ".join(passage[: 60 - i] + new(40))) for i in range(30)]
    found = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert {(r["id"], r["class_id"]) for r in found.collect()} == {(i, i - i % 2 if i < 200 else i) for i, _ in rows}


def test_rows_of_a_large_bucket_grow_with_its_members(spark, monkeypatch):
    """What is dealt of a text is bounded by its rare words, 21 of 100, and not by how many blocks its buckets have."""
    dealt, frame = [], type(spark.range(1))
    repartition = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda df, *by: dealt.append(df) or repartition(df, *by))
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "GROUP", 8, raising=False)
    rnd = random.Random(13)
    new = lambda n: [f"t{rnd.randrange(10**9)}" for _ in range(n)]
    passage, rows = new(60), []
    for i in range(150):
        tail = new(40)
        rows += [(2 * i, " ".join(passage + tail)), (2 * i + 1, " ".join(passage + [f"e{rnd.randrange(10**9)}" if k % 2 else w for k, w in enumerate(tail)]))]
    found = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert {(r["id"], r["class_id"]) for r in found.collect()} == {(i, i - i % 2) for i, _ in rows}
    assert 300 < max(df.count() for df in dealt) <= 300 * 21


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.integers(0, 30)), max_size=8), st.integers(0, 3), st.sampled_from([0.5, 0.8, 0.9]))
def test_texts_that_are_alike_share_a_rare_word(a, edits, seed, threshold):
    b = list(a)
    for kind, at, word in edits[: int((1 - threshold) * len(a) + 1e-9)]:
        at %= len(b) + 1
        b[at : at + (kind > 0)] = [word] * (kind < 2)
    levels = np.random.default_rng(seed).integers(0, 4, 1 << neardup.RANKS).astype(np.uint8)
    rare = [set(neardup.rare_words(np.array(x, np.uint32), levels, threshold).tolist()) for x in (a, b)]
    assert rare[0] & rare[1] or distance(a, b) > (1 - threshold) * max(len(a), len(b)) + 1e-9


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_word_counts_never_rule_out_what_is_alike(a, b):
    x, y = (np.frombuffer(neardup.word_counts(np.array(v * 60, np.uint32)), np.uint8) for v in (a, b))
    bins = min(len(x), len(y))
    x, y = (neardup.folded(v, bins).astype(int) for v in (x, y))
    common = sum((collections.Counter(a * 60) & collections.Counter(b * 60)).values())
    assert max(np.maximum(x - y, 0).sum(), np.maximum(y - x, 0).sum()) <= 60 * max(len(a), len(b)) - common


def test_near_dedup_keeps_one_of_pairs_that_no_hub_is_like(spark, schema):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(11)
    new = lambda n: [f"t{rnd.randrange(10**9)}" for _ in range(n)]
    passage, rows = new(60), []
    for i in range(50):
        tail = new(40)
        rows += [(2 * i, passage + tail), (2 * i + 1, passage + [f"e{rnd.randrange(10**9)}" if k % 2 else w for k, w in enumerate(tail)])]
    docs = spark.createDataFrame([(i, " ".join(x), "en", "a", len(" ".join(x))) for i, x in rows], schema)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == list(range(0, 100, 2))


def test_shuffle_files_go_once_a_table_is_written(spark):
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p for d in local for p in Path(d).rglob("shuffle_*")}
    before, setting = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set(setting, "false")
    try:
        found = shared.materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
        assert spark.conf.get(setting) == "false"
    finally:
        spark.conf.unset(setting)
    for _ in range(50):  # they go in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and found.count() == 7


def test_tables_of_words_and_buckets_go_when_classes_are_known(spark, docs):
    folder = Path(shared.checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    kept = neardup.one_of_each(docs, "doc_id", "text")
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert left and not left & {"sketches", "keys", "hubs", "held", "pairs", "needed", "words", "rooted"}
    assert 0 < kept.count() <= docs.count()


def test_repeated_rows_shuffle_texts_once(spark, odd, schema):
    rows = spark.createDataFrame(odd.collect() + odd.where("doc_id IS NULL").collect(), schema).where("text IS NOT NULL")
    setting = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(setting, "-1")
    try:
        kept = neardup.one_of_each(rows, "doc_id", "text")
        assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 4, 5, 6, 7, 8]
        plan = kept._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset(setting)
    assert plan.count("Exchange hashpartitioning") == 3  # texts, and what is kept by class and by key
