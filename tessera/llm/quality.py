"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Each rule rejects a document whose score is over a cutoff. For each stratum and rule,
cutoffs are tested from the loosest on: a cutoff is certified if, were the true share of
good documents that it rejects ``risk / rules`` or more, so few rejections among the
labelled good documents would have a chance of at most ``error / (strata * rules)``: the
exact binomial tail. Testing stops at the first cutoff that fails (fixed-sequence testing
needs no further correction; strata and rules are corrected by Bonferroni). Hence, with
confidence 1 - error, in every stratum at once, at most ``risk`` of the good documents
are rejected by all rules together. Among the certified cutoffs that reject ``WORTH``
bad documents for each good one, the loosest is taken that rejects most of the bad documents
that any of them rejects. A
stratum with too few labels certifies nothing, and its rules then reject nothing.

Null text has no words and fails the base rules. A null or unlisted stratum counts as
"other". Documents labelled twice count as good if any label says so; repeated rows are
judged one by one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import materialise

#: Cutoffs that are tested, loosest first.
CUTOFFS = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05)
RULES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio")
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Languages with cutoffs of their own; all others share one stratum.
STRATA = ("en", "fr", "de", "es")
RISK, ERROR, ENOUGH = 0.05, 0.1, 0.95
#: Bad documents that a cutoff rejects for each good one, at least.
WORTH = 20

_SPACE = r"[ \t-\r]"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once a row."""
    return F.transform(F.array(value), body)[0]


def _covered(words: Column, grams: Column, k: int) -> Column:
    """Words inside k-word windows that occur twice or more."""
    tagged = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))

    def repeated(rows: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return F.coalesce((x["g"] == y["g"]) & (F.slice(words, x["i"] + 1, k) == F.slice(words, y["i"] + 1, k)), F.lit(False))

        kept = F.filter(rows, lambda x, j: same(x, F.get(rows, j - 1)) | same(x, F.get(rows, j + 1)))
        starts = F.array_sort(F.transform(kept, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, p: F.struct((p + k).alias("end"), (acc["n"] + p + k - F.greatest(acc["end"], p)).alias("n"))
        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(_let(F.sort_array(tagged), repeated))


def features(text: Column, k: int = 5) -> Column:
    """A struct of FEATURES and of the scores of RULES for one text."""
    text = F.coalesce(text, F.lit(""))
    count = lambda of: F.length(F.regexp_replace(text, of, "")).cast("long")

    def of_words(words: Column) -> Column:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        starts = lambda h: F.slice(h, 1, F.greatest(F.size(h) - (k - 1), F.lit(0)))
        grams = lambda h: F.transform(starts(h), lambda x, i: F.xxhash64(x, *[F.get(h, i + d) for d in range(1, k)]))
        repeat = _let(hashes, lambda h: _let(grams(h), lambda g: _covered(words, g, k)))
        return F.struct(F.size(words).cast("long").alias("n_words"), repeat.alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    words = F.filter(F.split(text, _SPACE + "+"), lambda w: w != "")
    dup = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    raw = F.struct(_let(words, of_words).alias("w"), dup.alias("l"), count(_SPACE + "+").alias("word_chars"), count(r"[^#*$%&|<>]+").alias("n_symbols"), count(r"\P{Lu}+").alias("upper"))

    def scored(x: Column) -> Column:
        share = lambda a, b: a / F.greatest(b, F.lit(1))
        n = x["w"]["n_words"]
        return F.struct(
            n.alias("n_words"), x["word_chars"].alias("word_chars"), x["n_symbols"].alias("n_symbols"), x["l"]["n_dup_lines"].alias("n_dup_lines"), x["w"]["n_repeat_words"].alias("n_repeat_words"),
            share(x["n_symbols"], n).alias("symbol_ratio"), share(x["l"]["n_dup_lines"], x["l"]["n_lines"]).alias("dup_line_ratio"), share(x["w"]["n_repeat_words"], n).alias("repeat_ratio"),
            share(x["upper"], x["word_chars"]).alias("upper_ratio"),
        )

    return F.transform(F.array(raw), scored)


def with_features(df: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """The columns of ``keep`` and the features; generating them keeps their work from being repeated."""
    rows = df.select(*keep, F.col(text_col).alias("_text_"))
    return rows.select(*rows.columns[:-1], F.inline(features(F.col("_text_")))).withColumn("base_failed", base_failed())


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise(F.lit("other"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, taken back by the recurrence; x >= 1."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    for i in range(8):
        series = series - F.log(x + i)
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of n trials of chance p, summed from k downwards; 1 where k >= n p.

    Below the mean the terms fall from k on; those beyond 12 standard deviations and 50
    more count for nothing in double precision.
    """
    k, n = k.cast("double"), n.cast("double")
    at_k = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    steps = F.sequence(F.lit(0), F.least(k, F.ceil(F.sqrt(n * p) * 12) + 50).cast("int"))
    step = lambda acc, d: F.struct((acc["term"] * (k - d) * (1 - p) / ((n - k + d + 1) * p)).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))
    total = F.aggregate(steps, F.struct(at_k.alias("term"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(total, F.lit(1.0)))


def fit_cutoffs(labelled: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row a stratum (len(STRATA) + 1 at most) with a cutoff, or null, for each rule.

    ``labelled`` has stratum, good (boolean), base_failed and the scores. Documents that fail
    the base rules are no part of the holdout.
    """
    over = [F.sum(F.when(F.col("good") == good, (F.col(rule) > c).cast("long")).otherwise(0)).alias(f"{rule}_{i}_{good}") for rule in RULES for i, c in enumerate(CUTOFFS) for good in (True, False)]
    sums = labelled.where(~F.col("base_failed")).groupBy("stratum").agg(F.sum(F.col("good").cast("long")).alias("n"), *over)
    tests = [F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("i"), F.lit(c).alias("cutoff"), F.col(f"{rule}_{i}_True").alias("k"), F.col(f"{rule}_{i}_False").alias("bad")) for rule in RULES for i, c in enumerate(CUTOFFS)]
    tested = sums.select("stratum", "n", F.inline(F.array(*tests)))
    tested = tested.withColumn("passed", binomial_tail(F.col("k"), F.col("n"), risk / len(RULES)) <= error / ((len(STRATA) + 1) * len(RULES)))
    rule = tested.groupBy("stratum", "rule").agg(F.min(F.when(~F.col("passed"), F.col("i"))).alias("stop"), F.collect_list(F.struct("i", "cutoff", "k", "bad")).alias("all"))
    certified = F.filter("all", lambda x: (F.col("stop").isNull() | (x["i"] < F.col("stop"))) & (x["k"] * WORTH <= x["bad"]))
    most = F.array_max(F.transform(certified, lambda x: x["bad"]))
    chosen = F.array_max(F.transform(F.filter(certified, lambda x: (x["bad"] >= most * ENOUGH) & (most > 0)), lambda x: x["cutoff"]))
    return rule.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, chosen)).alias(f"{r}_cutoff") for r in RULES])


def with_verdict(scored: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add kept. ``cutoffs`` has a row a stratum, a number fixed by STRATA, so it is broadcast."""
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.col(r) > F.col(f"{r}_cutoff"), F.lit(False))
    return scored.join(F.broadcast(cutoffs), "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejected)


def labelled_features(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The scored documents that have a label, and whether it is good."""
    good = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg((F.max("quality") == 1).alias("good"))
    return scored.select(F.col(id_col).alias("_doc_id"), "stratum", "base_failed", *RULES).join(good, F.col("_doc_id") == F.col("_id"))


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows and columns of ``docs`` that the rules keep.

    Documents are scored once and written with their scores. Of these the fit reads ids and
    scores only, so no text is shuffled to meet its label.
    """
    rows = docs.select(F.struct("*").alias("_doc"), F.col(text_col).alias("_text"), stratum(F.col(lang_col)).alias("stratum"))
    scored = materialise(with_features(rows, "_text", F.col("_doc"), F.col("stratum")), "scored")
    cutoffs = fit_cutoffs(labelled_features(scored.withColumn("_row_id", F.col("_doc").getField(id_col)), labels, "_row_id"))
    return with_verdict(scored, cutoffs).where("kept").select("_doc.*")
