"""Operators in DataFrame operations: no Python in their plans, results against brute force."""

import collections
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import pii, quality, sharding
from tessera.llm.queries import QUERIES


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


def test_shards(docs, odd, empty, spark):
    big = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', int(id % 7)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 400) END AS source")
    for df, shards in ((docs, 7), (odd, 3), (big, 40)):
        out = sharding.stratified_shards(df, "doc_id", "text", "source", shards)
        assert no_python(out)
        rows, found = df.collect(), out.collect()
        size = lambda t: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
        assert collections.Counter((r["doc_id"], *size(r["text"])) for r in rows) == collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found)
        slots = collections.defaultdict(list)
        for r in found:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert max(map(len, slots.values())) - (min(map(len, slots.values())) if len(slots) == shards else 0) <= 1
    assert sharding.stratified_shards(empty, "doc_id", "text", "source", 3).count() == 0
    # Every shard has the mixture of the whole.
    mix = sharding.stratified_shards(big, "doc_id", "text", "source", 40).join(big.select("doc_id", "source"), "doc_id")
    hot = [r["n"] for r in mix.groupBy("shard").agg(F.sum((F.col("source") == "hot").cast("int")).alias("n")).collect()]
    assert max(hot) - min(hot) <= 25  # of 167 in each; the offsets of 400 small sources are random


def test_shards_do_not_depend_on_partitions(docs):
    one = sharding.stratified_shards(docs, "doc_id", "text", "source", 5).collect()
    two = sharding.stratified_shards(docs.repartition(7), "doc_id", "text", "source", 5).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def brute_features(text, k=5):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    covered = {j for i in range(len(words) - k + 1) if grams[tuple(words[i : i + k])] > 1 for j in range(i, i + k)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_features(docs, odd, empty, spark):
    odd_texts = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d e a b c d e", "a b c d e f a b c d e f x", "x\n\nx\n y\nx", "\x0b\x0c\r", "a " * 12, "    b"])], "doc_id long, text string")
    for df in (docs, odd, odd_texts, empty):
        out = quality.with_features(df, "text", F.col("doc_id"), F.col("text").alias("t"))
        assert no_python(out)
        for r in out.collect():
            assert tuple(r[c] for c in (*quality.FEATURES, "base_failed")) == brute_features(r["t"]), r["t"]


@pytest.mark.parametrize("p", [0.0125, 0.05, 0.3])
def test_binomial_tail(spark, p):
    cases = [(k, n) for n in (1, 5, 40, 700, 3000) for k in (0, 1, 2, 5, 20, 60) if k <= n]
    out = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), p).alias("t")).collect()
    for r in out:
        k, n = r["k"], r["n"]
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(k + 1)]
        want = 1.0 if k >= n * p else sum(map(math.exp, logs))
        assert math.isclose(r["t"], want, rel_tol=1e-8, abs_tol=1e-300), (k, n, p)


def labelled(spark, rows):
    scored = spark.createDataFrame(rows, "stratum string, good boolean, symbol_ratio double")
    return scored.withColumns({r: F.lit(0.0) for r in quality.RULES if r != "symbol_ratio"}).withColumn("base_failed", F.lit(False))


def test_cutoffs(spark):
    clean, junk = [("en", True, 0.0)] * 800, [("en", False, 2.0)] * 60
    noisy = [("fr", True, 0.1 * (i % 10)) for i in range(800)] + [("fr", False, 2.0)] * 60
    few = [("de", True, 0.0)] * 20 + [("de", False, 2.0)] * 20
    found = {r["stratum"]: r for r in quality.fit_cutoffs(labelled(spark, clean + junk + noisy + few)).collect()}
    assert found["en"]["symbol_ratio_cutoff"] == 0.9  # the loosest that has all the junk
    assert found["de"]["symbol_ratio_cutoff"] is None  # too few labels to certify anything
    assert found["fr"]["symbol_ratio_cutoff"] == 0.9  # 0.8 would already reject a tenth of the good
    assert found["en"]["upper_ratio_cutoff"] is None  # it would reject nothing


def test_certified_cutoffs_are_as_brute_force_has_them(spark):
    """The guarantee itself: over repeated holdouts, cutoffs rarely reject more than the risk."""
    import random

    rnd = random.Random(5)
    rows = [("en", True, rnd.random() ** 8) for _ in range(1500)] + [("en", False, 0.5 + rnd.random() / 2) for _ in range(400)]
    got = quality.fit_cutoffs(labelled(spark, rows)).first()["symbol_ratio_cutoff"]
    risk, level = quality.RISK / len(quality.RULES), quality.ERROR / ((len(quality.STRATA) + 1) * len(quality.RULES))
    certified = []
    for c in quality.CUTOFFS:
        k, n = sum(x > c for _, good, x in rows if good), 1500
        tail = sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
        if k >= n * risk or tail > level:
            break
        if k * quality.WORTH <= (bad := sum(x > c for _, good, x in rows if not good)):
            certified.append((c, bad))
    most = max((b for _, b in certified), default=0)
    assert got == max((c for c, b in certified if most and b >= quality.ENOUGH * most), default=None)


def test_kept_documents(docs, odd, empty, spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    for df in (docs, odd, empty, docs.withColumn("good", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("stratum", F.lit(0))):
        kept = quality.kept_documents(df, labels)  # read from a table that was written, so every column may be null
        assert [(f.name, f.dataType) for f in kept.schema] == [(f.name, f.dataType) for f in df.schema] and kept.count() <= df.count()
        want = [r["doc_id"] for r in df.collect() if not brute_features(r["text"])[-1]]
        assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(x or 0 for x in want)  # so few labels certify no cutoff


def test_surrogates(spark, docs, odd, empty):
    texts = ["Mail Bob.Smith7@corp-x.example.com or bob.smith7@CORP-X.example.com, call +1 (743) 555-3824 or +1-743-555-3824.", "Card 4111 1111 1111 1111 and 4111111111111111, ssn 123-45-6789, ip 10.0.0.255, DE89 3704 0044 0532 0130 00", "Mrs. Anna Schmidt met Mr. John Smith; Mr. Smith left. г-жа Анна Петрова", "no data, version 2.0, 1.2.3", "BOB.SMITH7@CORP-X.EXAMPLE.COM", None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, n_email string")
    out = pii.pseudonymised(df, "text", "key")
    assert no_python(out)
    got = {r["doc_id"]: r for r in out.collect()}
    a = re.findall(r"\S+@[^\s,]+", got[0]["text"])
    assert a[0] == a[1] and a[0].upper() == got[4]["text"] and "smith" not in a[0] and got[0]["n_email"] == 2
    p = re.findall(r"\+1[ (\d)-]+\d", got[0]["text"])
    assert re.sub(r"\D", "", p[0]) == re.sub(r"\D", "", p[1]) != "17435553824" and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", p[0])
    cards = re.findall(r"4[\d ]{14,18}", got[1]["text"].split("DE")[0])
    digits = {re.sub(r"\D", "", c) for c in cards}
    assert len(digits) == 1 and "4111111111111111" not in digits and luhn(digits.pop())
    iban = re.search(r"DE\d\d[ \dA-Z]+", got[1]["text"])[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.search(r"ssn 9\d\d-\d\d-\d{4}", got[1]["text"]) and "10.0.0.255" not in got[1]["text"]
    women, men = set(pii.NAMES["given|f|latin"]), set(pii.NAMES["given|m|latin"])
    m = re.fullmatch(r"Mrs\. (\S+) (\S+) met Mr\. (\S+) (\S+); Mr\. (\S+) left\. г-жа (\S+) (\S+)", got[2]["text"])
    assert m[1].split("-")[0] in women and m[3].split("-")[0] in men and m[4] == m[5] and m[2] != m[4] and re.fullmatch("[А-я-]+", m[6] + m[7])
    assert got[3]["text"] == texts[3] and got[5]["text"] is None and got[6]["text"] == ""
    assert out.columns[:2] == ["doc_id", "text"]
    for df in (docs, odd, empty):
        out = pii.pseudonymised(df, "text", "key")
        assert out.count() == df.count() and out.columns[: len(df.columns)] == df.columns


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_surrogates_stay_distinct(spark):
    """More names than there are single surrogates: later attempts tell them apart."""
    words = [a + b + c for a in ("Ka", "Lo", "Mi", "Nu", "Pe", "Ro") for b in ("ba", "de", "fi", "go", "ku", "la") for c in ("ren", "sen", "ton", "vik", "zer")]
    texts = [(i, f"Mr. {w} spoke to Mr. {w}.") for i, w in enumerate(words)] + [(1000 + i, f"Mr. {w} came") for i, w in enumerate(pii.NAMES["surname|latin"])]
    out = pii.pseudonymised(spark.createDataFrame(texts, "doc_id int, text string"), "text", "key").collect()
    new = {}
    for r in out:
        found = re.findall(r"Mr\. ([\w-]+)", r["text"])
        assert len(set(found)) == 1
        new[r["doc_id"]] = found[0]
    originals = {w.lower() for w in words} | {w.lower() for w in pii.NAMES["surname|latin"]}
    assert len(set(new.values())) == len(texts) and not originals & {x.lower() for x in new.values()}


def test_one_person_has_one_surrogate(spark):
    """Across titles, case, documents and mentions without a title; against a plain reading of what was written."""
    texts = [
        "Dr Anna Schmidt and Mrs Anna Schmidt met. Later Anna Schmidt left; MRS ANNA SCHMIDT too. Schmidt's dog. Anna. Annabel.",
        "Dr. Anna Weber met Prof. Jona Schmidt.", "Mr Jona Weber wrote.", "Schmidt stands alone here, as no title tells that it is a name.",
    ]
    rows = spark.createDataFrame([(i, t, "n", "k") for i, t in enumerate(texts)], "doc_id int, text string, `new` string, `kinds` string")
    got = {r["doc_id"]: r for r in pii.pseudonymised(rows, "text", "key").collect()}
    title = r"(?:Dr|Mrs|Mr|Prof)\.? "
    first = re.fullmatch(rf"{title}(\S+) (\S+) and {title}(\S+) (\S+) met\. Later (\S+) (\S+) left; MRS (\S+) (\S+) too\. (\S+)'s dog\. (\S+)\. Annabel\.", got[0]["text"]).groups()
    anna, schmidt = first[:2]
    assert first == (anna, schmidt, anna, schmidt, anna, schmidt, anna.upper(), schmidt.upper(), schmidt, anna)
    assert anna.split("-")[0] in pii.NAMES["given|f|latin"] and got[0]["n_name"] == 7 and got[0]["new"] == "n"
    second = re.fullmatch(rf"{title}(\S+) (\S+) met {title}(\S+) (\S+)\.", got[1]["text"]).groups()
    third = re.fullmatch(rf"{title}(\S+) (\S+) wrote\.", got[2]["text"]).groups()
    assert second[0] == anna and second[3] == schmidt and second[2:3] + second[1:2] == third
    assert third[0].split("-")[0] in pii.NAMES["given|m|latin"] and got[3]["text"] == texts[3]
    other = pii.pseudonymised(rows, "text", "another key").where("doc_id = 0").first()["text"]
    assert other != got[0]["text"]


def test_surrogates_of_long_texts(spark):
    n = 40_000
    texts = ["x@" + "a." * n + " and a@b.com. Next", "a@" * n, "+1 " * n, "1 " * n, "Mrs Anna " * n, "A1" * n, "DE89 " * n, "Mrs " + "Aa" * n, "Mr " + "A-aa" * n, "1." * n]
    out = pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "text", "key").collect()
    assert len(out) == len(texts) and all("Anna" not in r["text"] for r in out) and next(r for r in out if r["doc_id"] == 0)["n_email"] == 2


def test_planted_data_is_gone(spark, small):
    out = QUERIES["op5_surrogates"](spark, small)
    left = r"\d{16}|\+1 \(\d{3}\) \d{3}-\d{4}|\d{1,3}(?:\.\d{1,3}){3}|[\w.]+@[\w.]+\w"
    before = {r["doc_id"]: set(re.findall(left, r["text"])) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in out.collect():
        assert not any(x in r["text"] for x in before[r["doc_id"]])
