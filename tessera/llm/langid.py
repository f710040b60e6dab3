"""Language identification of mixed text.

Words are runs of letters. The script of a word's first letter leaves as candidates the
languages that are written in it; hashed n-grams of two to four bytes, word ends
included, give each candidate a score for the word. Viterbi's algorithm with a penalty
for each switch then labels spans of words. A document's language is the one that has
most letters; its score is that language's share of the letters.

Most texts have one language. Where no stretch of words favours another language by half
the penalty, staying is the best path, which prefix sums show without going word by word.

The model is fitted on a hash sample of about ``FIT_DOCS`` labelled documents; its size
does not depend on the corpus. Null texts and texts without a letter are "und" with score
0; without any labelled text everything is "und". Null languages are not learned from, nor
any beyond the ``LANGUAGES`` that most of the sampled rows have; repeated rows count as often
as they come; other columns are ignored, whatever their names; of languages with equal scores
the first by name is taken; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .bpe import slices
from .neardup import text_buffer

FIT_DOCS, ORDERS, BITS, SMOOTH, PENALTY, SCRIPT_SHARE = 20_000, (2, 3, 4), 17, 0.5, 16.0, 0.002
#: Languages that a model has at most, which bounds what comes to the driver and goes to executors.
LANGUAGES = 64
ODD = np.uint32(2654435761)
#: Lead bytes of UTF-8 (inclusive) of the letters of a script.
SCRIPTS = {"latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC2, 0xCA)), "greek": ((0xCD, 0xCF),), "cyrillic": ((0xD0, 0xD4),), "armenian_hebrew": ((0xD5, 0xD7),), "arabic": ((0xD8, 0xDD),), "indic": ((0xE0, 0xE0),), "asian": ((0xE1, 0xED),), "other": ((0xCB, 0xCC), (0xDE, 0xDF), (0xEE, 0xF4))}
SCRIPT_OF = np.full(256, -1, np.int8)
for _i, _ranges in enumerate(SCRIPTS.values()):
    for _a, _b in _ranges:
        SCRIPT_OF[_a : _b + 1] = _i
LETTER = (SCRIPT_OF >= 0) | ((np.arange(256) >= 0x80) & (np.arange(256) < 0xC0))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of letters; those of marks and symbols beyond ASCII are none."""
    letter = LETTER[data]
    nxt = np.append(data[1:], np.uint8(0))
    marks = (
        (data == 0xC2, 2), ((data == 0xC3) & ((nxt == 0x97) | (nxt == 0xB7)), 2), ((data == 0xE2) & (nxt < 0xB0), 3), ((data == 0xE3) & (nxt == 0x80), 3), ((data == 0xF0) & (nxt == 0x9F), 4),
    )
    for found, size in marks:
        at = np.flatnonzero(found)
        for k in range(size if len(at) else 0):
            letter[np.minimum(at + k, len(data) - 1)] = False
    return letter


def grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Positions at which n-grams end, their hashes by order, where words start, and word ends (exclusive)."""
    low = np.append(LOWER[data], np.uint8(0))
    high = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[1:-1][high] += 32
    letter = np.append(_letters(data), False)
    low[~letter] = 0
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    at_bounds = bounds[:-1][bounds[:-1] < len(data)]
    begins[at_bounds] |= letter[at_bounds]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(letter[:-1] & (~letter[1:] | begins[1:])) + 1
    cur = low.astype(np.uint32)
    p1 = np.append(np.uint32(0), cur[:-1])
    p1[begins] = 0
    p2 = np.append(np.zeros(2, np.uint32), cur[:-2])[: len(cur)]
    p2[p1 == 0] = 0
    p3 = np.append(np.zeros(3, np.uint32), cur[:-3])[: len(cur)]
    p3[p2 == 0] = 0
    # Grams end inside a word or right after it, where the end itself is a mark.
    used = letter.copy()
    used[ends] |= ~begins[ends]
    at = np.flatnonzero(used)
    x = (cur | p1 << np.uint32(8) | p2 << np.uint32(16) | p3 << np.uint32(24))[at]
    masks = {2: np.uint32(0xFFFF), 3: np.uint32(0xFFFFFF), 4: np.uint32(0xFFFFFFFF)}
    return at, [((x & masks[n]) * (ODD + np.uint32(2 * n))) >> np.uint32(32 - BITS) for n in ORDERS], starts, ends


@dataclass
class Model:
    languages: list[str]
    tables: list[np.ndarray]  # an order's scores: 2**BITS by language
    allowed: np.ndarray  # script by language: 0 or a large negative number

    def word_scores(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of all words by language, and where the words start and end."""
        at, hashed, starts, ends = grams(data, bounds)
        if not len(starts):
            return np.zeros((0, len(self.languages)), np.float32), starts, ends
        scores = self.tables[0][hashed[0]]
        for table, h in zip(self.tables[1:], hashed[1:]):
            scores += table[h]
        words = np.add.reduceat(scores, np.searchsorted(at, starts), axis=0)
        return words + self.allowed[SCRIPT_OF[data[starts]]], starts, ends


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of each word where every switch costs ``penalty``; ties go to the first."""
    n, k = scores.shape
    if k == 1 or n == 0:
        return np.zeros(n, np.int64)
    total = scores.sum(axis=0, dtype=np.float64)
    main = int(total.argmax())
    gain = np.cumsum(scores - scores[:, main : main + 1], axis=0, dtype=np.float64)
    low = np.minimum.accumulate(np.vstack([np.zeros(k), gain[:-1]]), axis=0)
    if ((gain - low).max() if n else 0) <= penalty / 2:
        return np.full(n, main)
    best, came, tops = [0.0] * k, [], []
    for row in scores.tolist():
        most = max(best)
        floor = most - penalty
        came.append([x < floor for x in best])
        tops.append(best.index(most))
        best = [(x if x >= floor else floor) + y for x, y in zip(best, row)]
    out, state = np.empty(n, np.int64), best.index(max(best))
    for i in range(n - 1, -1, -1):
        out[i] = state
        if came[i][state]:
            state = tops[i]
    return out


def fit(df: DataFrame, text_col: str, lang_col: str, key: Column, docs: int = FIT_DOCS) -> Model:
    """A model from about ``docs`` rows with a language, sampled by a hash of ``key``."""
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = min(1.0, docs / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else known

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", 1 << 20):
            data, bounds = text_buffer(batch, "text")
            at, hashed, starts, _ = grams(data, bounds) if len(data) else (np.empty(0, int), [], np.empty(0, int), None)
            if not len(starts):
                continue
            doc = np.searchsorted(bounds, np.minimum(at, len(data) - 1), "right") - 1
            first = np.searchsorted(bounds, starts, "right") - 1
            langs, code = np.unique(batch.column("lang").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            for i, lang in enumerate(langs):
                c = counts.setdefault(lang, np.zeros((len(ORDERS) << BITS) + len(SCRIPTS), np.int64))
                mine = code[doc] == i
                for o, h in enumerate(hashed):
                    c[o << BITS : (o + 1) << BITS] += np.bincount(h[mine], minlength=1 << BITS)
                c[len(ORDERS) << BITS :] += np.bincount(SCRIPT_OF[data[starts[code[first] == i]]].clip(0), minlength=len(SCRIPTS))
        for lang, c in counts.items():
            slot = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot)), pa.array(slot, pa.int32()), pa.array(c[slot], pa.int64())], names=["lang", "slot", "n"])

    rows = sample.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    often = [r["lang"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()]
    rows = rows.where(F.col("lang").isin(often))
    # A slot for each hash and language, so what comes to the driver is bounded.
    table = rows.mapInArrow(work, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    lang, slot, n = (table.column(c).to_numpy() for c in ("lang", "slot", "n"))
    languages = sorted(set(lang.tolist()))
    dense = np.zeros((len(languages), (len(ORDERS) << BITS) + len(SCRIPTS)))
    dense[np.searchsorted(languages, lang.astype(str)) if len(lang) else slot, slot] = n
    tables = []
    for o in range(len(ORDERS)):
        c = dense[:, o << BITS : (o + 1) << BITS] + SMOOTH
        logs = np.log(c / c.sum(axis=1, keepdims=True))
        tables.append(np.ascontiguousarray((logs - logs.max(axis=0)).T.clip(-6, 0) / len(ORDERS), np.float32) if len(languages) else np.zeros((1 << BITS, 0), np.float32))
    script = dense[:, len(ORDERS) << BITS :]
    usual = script >= SCRIPT_SHARE * script.sum(axis=1, keepdims=True)
    allowed = np.where(usual | ~usual.any(axis=0), 0.0, -50.0).T.astype(np.float32)
    return Model(languages, tables, allowed)


def labelled_spans(df: DataFrame, text_col: str, model: Model, penalty: float = PENALTY) -> DataFrame:
    """All columns of ``df`` but the text, and lang_pred, score and spans (start, end in code points, lang).

    Added columns replace those of the same name.
    """
    added = ("lang_pred", "score", "spans")
    kept = [F.col("row").getField(c).alias(c) for c in df.columns if c not in (text_col, *added)]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    names = ["row", *added]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def one(scores, starts, ends, place) -> tuple[str, float, list]:
        path = viterbi(scores, penalty)
        size = np.bincount(path, weights=ends - starts, minlength=len(shared.value.languages))
        cuts = np.flatnonzero(np.diff(path)) + 1
        heads, tails = np.append(0, cuts), np.append(cuts, len(path)) - 1
        spans = [{"start": int(place[starts[h]]), "end": int(place[ends[t] - 1]) + 1, "lang": shared.value.languages[path[h]]} for h, t in zip(heads, tails)]
        top = int(size.argmax())
        return shared.value.languages[top], float(size[top] / size.sum()), spans

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            data, bounds = text_buffer(batch, "text")
            found = [("und", 0.0, [])] * batch.num_rows
            if len(data) and shared.value.languages:
                scores, starts, ends = shared.value.word_scores(data, bounds)
                place = np.cumsum((data & 0xC0) != 0x80) - 1
                cut = np.searchsorted(starts, bounds)
                ascii_letters = np.append(0, np.cumsum((data | 32) - 97 < 26))
                for i, (a, b) in enumerate(zip(cut, cut[1:])):
                    if bounds[i] == bounds[i + 1]:
                        continue
                    if ascii_letters[bounds[i]] == ascii_letters[bounds[i + 1]] and not any(map(str.isalpha, batch.column("text")[i].as_py())):
                        continue
                    if a == b:  # odd letters that make no word tell nothing
                        found[i] = shared.value.languages[0], 1 / len(shared.value.languages), []
                        continue
                    base = place[bounds[i]]
                    lang, score, spans = one(scores[a:b], starts[a:b], ends[a:b], place)
                    found[i] = lang, score, [s | {"start": s["start"] - int(base), "end": s["end"] - int(base)} for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], span)], names=names)

    # The text goes once; the other columns as one struct, so that no names can clash.
    others = [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c not in (text_col, *added)]
    rows = df.select(F.struct(*(others or [F.lit(None).alias("none")])).alias("row"), F.col(text_col).alias("text"))
    found = T.StructType.fromDDL("lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>")
    schema = T.StructType([rows.schema["row"], *found.fields])
    return rows.mapInArrow(work, schema).select(*kept, *added)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows and columns of ``docs`` that have a language with ``least`` of their letters.

    The model learns from the rows that are not held out.
    """
    model = fit(docs.where(~held_out(F.col(id_col))), text_col, lang_col, F.col(id_col))
    rows = docs.select(F.struct("*").alias("_doc"), F.col(text_col).alias("_t"))
    return labelled_spans(rows, "_t", model).where(f"lang_pred != 'und' AND score >= {least}").select("_doc.*")
