"""Near duplicates by order min-hash and banded alignment.

A text's words are hashed, and every run of ``K`` words is labelled with how often it
occurred before in the text. For each of ``ORDERED`` orders the ``TAKE`` least labelled
runs are taken *in text order*; their hash is one sketch. Unlike plain min-hash this
tells texts apart that hold the same runs in another order, so it follows edit
similarity. Texts at the threshold with edits all over have few runs in common, so that both
runs seldom agree; the rest of the ``SKETCHES`` take one run each. Texts that share a sketch
are first candidates of the bucket's two hubs, its least and its greatest member.

Candidates are verified by alignment: 1 - (word edits) / (words of the longer) must reach
``threshold``. First only the best candidate of every text is aligned; then, of all other
candidates, those whose texts are not yet in one class. Most buckets are one class by then. Where
one is not, because its members share no more than a passage, all pairs of its members from
different classes are compared, so that no two texts with a common sketch stay uncompared.
What spares an alignment throughout is a bound that never errs: a text's words are counted in bins,
and texts whose counts differ by more than the edits allowed cannot be alike. Members of buckets of
more than ``BLOCK`` meet by their rarest words instead, one more than the edits allowed, of which
texts that are alike always share one; so no text is copied once for each block of a bucket. Whether
two near copies share a sketch is a matter of chance, as with any min-hash; README.md has
measured shares. Classes are the components of the verified links; they are found by hooking
and pointer jumping over tables, and the links never come to the driver.

Texts are told apart by their MD5, so exact copies are one node from the start. Null
texts are each a class of their own; equal texts, empty ones too, share a class; a class
is named by its least id (nulls are passed over). Texts of fewer than ``K`` words have
one run. Of equally good candidates the greatest MD5 is aligned first. Other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import slices
from .shared import materialise, release

K, TAKE, THRESHOLD = 5, 2, 0.8
#: Sketches of ``TAKE`` runs, and all: those after them take one run each.
ORDERED, SKETCHES = 12, 38
_RNG = np.random.default_rng(20240229)
_odd = lambda n: _RNG.integers(0, 2**63, n, np.uint64) << np.uint64(1) | np.uint64(1)
BYTE, PLACE = _odd(256), _odd(4096)
FACTORS, RUN, SHIFT = _odd(ORDERED), _odd(K), _RNG.integers(0, 2**63, ORDERED, np.uint64)
FACTORS = np.append(FACTORS, _odd(SKETCHES - ORDERED))
SHIFT = np.append(SHIFT, _RNG.integers(0, 2**63, SKETCHES - ORDERED, np.uint64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
MIX = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 20
#: Bins of word counts, by the length of the text, and members of a bucket that are compared as one group.
BINS, BLOCK = (7, 12), 2048
#: Words are ranked by how often those of their hash value are there, of 2 ** RANKS; texts for each group of rare words.
RANKS, GROUP = 18, 4096


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end in ``data``, and where each text's begin.

    ``bounds`` has the texts' ends and, first, 0. Long data is hashed in chunks cut at white space.
    """
    space = SPACE[data]
    after = np.append(True, space)[: len(data)]
    after[bounds[:-1][bounds[:-1] < len(data)]] = True
    starts = np.flatnonzero(~space & after)
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK)))
        end = starts[to] if to < len(starts) else len(data)
        part, begin = data[starts[at] : end], starts[at:to] - starts[at]
        within = np.arange(len(part)) - np.repeat(begin, np.diff(np.append(begin, len(part))))
        value = BYTE[part] * PLACE[within & 4095]
        value[space[starts[at] : end]] = 0
        hashes[at:to] = np.add.reduceat(value, begin)
        at = to
    return _mix(hashes), np.searchsorted(starts, bounds)


def text_buffer(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its bounds, without a copy; nulls are empty."""
    col = batch.column(column)
    _, offsets, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    bounds = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(col) else np.empty(0, np.uint8)
    return raw, bounds - bounds[0]


def labelled_runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words of a text and of how often each occurred before."""
    runs = np.zeros(max(1, len(words) - k + 1), np.uint64)
    for j in range(min(k, len(words))):
        runs += words[j : j + len(runs)] * RUN[j]
    order = np.argsort(runs, kind="stable")
    ranked = runs[order]
    same = ranked[1:] == ranked[:-1]
    if same.any():
        begin = np.maximum.accumulate(np.where(np.append(False, same), 0, np.arange(len(runs))))
        label = np.empty(len(runs), np.uint64)
        label[order] = np.arange(len(runs)) - begin
        runs = runs + label * MIX
    return _mix(runs)


def sketches(words: np.ndarray) -> np.ndarray:
    """SKETCHES hashes of one text's word hashes; none for a text without words."""
    if len(words) == 0:
        return np.empty(0, np.int64)
    return _least(labelled_runs(words, K), FACTORS, SHIFT, ORDERED)


def _least(runs: np.ndarray, factors: np.ndarray, shift: np.ndarray, ordered: int) -> np.ndarray:
    """A hash for each order of the runs: of the TAKE least in text order for the first ``ordered``, of the least for the others."""
    out = np.empty(len(factors), np.uint64)
    step = max(1, (1 << 19) // len(runs))
    parts = [(x, min(x + step, end), take) for begin, end, take in ((0, ordered, TAKE), (ordered, len(factors), 1)) for x in range(begin, end, step)]
    for a, to, take in parts:
        h = runs[None, :] * factors[a:to, None] + shift[a:to, None]
        at = np.arange(len(h))
        picks = np.empty((len(h), min(take, len(runs))), np.int64)
        for t in range(picks.shape[1]):
            picks[:, t] = h.argmin(axis=1)
            h[at, picks[:, t]] = np.uint64(2**64 - 1)
        picks.sort(axis=1)
        value = np.arange(a, a + len(h), dtype=np.uint64) * MIX
        for t in range(picks.shape[1]):
            value = _mix(value + runs[picks[:, t]] * RUN[t])
        out[a:to] = value
    return out.view(np.int64)


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether at most ``most`` insertions, deletions and replacements turn ``a`` into ``b``."""
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    diff = np.flatnonzero(a[:n] != b[:n])
    lead = int(diff[0]) if len(diff) else n
    a, b = a[lead:], b[lead:]
    n = min(len(a), len(b))
    diff = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(diff[0]) if len(diff) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if max(len(a), len(b)) <= most:
        return True
    if min(len(a), len(b)) == 0:
        return False
    ua, ia, ca = np.unique(a, return_index=True, return_counts=True)
    ub, ib, cb = np.unique(b, return_index=True, return_counts=True)
    _, xa, xb = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if max(len(a), len(b)) - int(np.minimum(ca[xa], cb[xb]).sum()) > most:
        return False  # too few words in common, wherever they stand
    return _chained_bound(a, b, most) <= most or banded_distance(a, b, most) <= most


def _chained_bound(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edits of an alignment through three-word runs that both have once, in the band: no fewer than needed."""
    if min(len(a), len(b)) < 3:
        return max(len(a), len(b))
    runs = lambda x: x[:-2].astype(np.uint64) * RUN[0] + x[1:-1].astype(np.uint64) * RUN[1] + x[2:].astype(np.uint64) * RUN[2]
    (ua, ia, ca), (ub, ib, cb) = (np.unique(runs(x), return_index=True, return_counts=True) for x in (a, b))
    _, xa, xb = np.intersect1d(ua[ca == 1], ub[cb == 1], assume_unique=True, return_indices=True)
    left, right = ia[ca == 1][xa], ib[cb == 1][xb]
    inside = (np.abs(left - right) <= most) & (a[left] == b[right])
    order = np.argsort(left[inside])
    left, right = left[inside][order].tolist(), right[inside][order].tolist()
    # The longest chain that rises on both sides.
    tops, tails, back = [], [], [-1] * len(right)
    for i, y in enumerate(right):
        j = bisect_left(tops, y)
        back[i] = tails[j - 1] if j else -1
        if j == len(tops):
            tops.append(y)
            tails.append(i)
        else:
            tops[j], tails[j] = y, i
    i, x1, y1, bound = tails[-1] if tails else -1, len(a), len(b), 0
    while i >= 0 and bound <= most:
        if left[i] + 1 < x1 or right[i] + 1 < y1:
            bound += _gap_edits(a[left[i] + 1 : x1].tolist(), b[right[i] + 1 : y1].tolist())
        x1, y1, i = left[i], right[i], back[i]
    return bound + (_gap_edits(a[:x1].tolist(), b[:y1].tolist()) if bound <= most else 0)


def _gap_edits(a: list[int], b: list[int], cells: int = 10_000) -> int:
    """Edits of a gap between matches: exact in a small table, else from above."""
    while a and b and a[-1] == b[-1]:
        a.pop()
        b.pop()
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    if not a or not b or len(a) * len(b) > cells:
        return max(len(a), len(b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _band_masks(a: np.ndarray, width: int):
    """mask(symbol, start): bit k tells whether ``a[start + k]`` is the symbol, for 0 <= k < width and places in ``a``.

    Symbols that are often there keep one mask over all of ``a``; their number is bounded.
    """
    order = np.argsort(a, kind="stable")
    ranked = a[order]
    cut = np.append(np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])[: len(a)]), len(a))
    places = {int(ranked[x]): order[x:y] for x, y in zip(cut, cut[1:])}
    whole, full = {}, (1 << width) - 1

    def bits(at: np.ndarray, size: int) -> int:
        held = np.zeros(size, bool)
        held[at] = True
        return int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")

    def mask(symbol: int, start: int) -> int:
        at = places.get(symbol)
        if at is None:
            return 0
        if len(at) * 512 >= len(a):
            if (all_ := whole.get(symbol)) is None:
                all_ = whole[symbol] = bits(at, len(a))
            return (all_ >> start if start >= 0 else all_ << -start) & full
        near = at[np.searchsorted(at, start) : np.searchsorted(at, start + width)] - start
        if len(near) > 8:
            return bits(near, width)
        out = 0
        for k in near.tolist():
            out |= 1 << k
        return out

    return mask


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance over the diagonals within ``most``; most + 1 if it is greater.

    A column of the band is two bit rows, of the steps up and down between its neighbours
    (Hyyrö's banded form of Myers' algorithm), which move down the main diagonal. So a column
    costs a few operations on integers of ``2 * most + 1`` bits, however long the texts are.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    width = 2 * most + 1
    mask, full, top = _band_masks(a, width), (1 << width) - 1, 1 << width - 1
    # Bit k of column j stands for row j + k - most of a; the last is the lowest diagonal.
    up, down, score = full ^ (1 << most) - 1, 0, min(most, n)
    for j, symbol in enumerate(b.tolist(), 1):
        equal = mask(symbol, j - 1 - most)
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & full
        right, left = (down | ~(diagonal | up)) & full, diagonal & up
        # The lowest diagonal is followed while it is inside the table, then its last row.
        if j + most <= n:
            score += not diagonal & top
        else:
            row = 1 << n - j + most if n - j + most >= 0 else 0
            score += bool(right & row) - bool(left & row)
        if score > 3 * most:  # no cell of this column within the band is within ``most``
            return most + 1
        diagonal >>= 1
        up, down = (left | ~(diagonal | right)) & full, diagonal & right
    return min(score, most + 1)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def sketch_rows(rows: DataFrame) -> DataFrame:
    """node, keys: a hash of each sketch and its number, of rows (node, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            words, at = word_hashes(*text_buffer(batch, "text"))
            keys = [sketches(words[a:b]) for a, b in zip(at, at[1:])]
            ends = np.cumsum([0, *map(len, keys)])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("id"), listed], names=["node", "id", "keys"])

    return rows.mapInArrow(work, f"node binary, id {_kind(rows, 'id')}, keys array<long>")


def word_rows(rows: DataFrame) -> DataFrame:
    """node, id, words: the word hashes of (node, id, text), 32 bits each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            words, at = word_hashes(*text_buffer(batch, "text"))
            words = (words >> np.uint64(32)).astype("<u4")
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("id"), pa.array([words[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], names=["node", "id", "words"])

    return rows.mapInArrow(work, f"node binary, id {_kind(rows, 'id')}, words binary")


def word_counts(words: np.ndarray) -> bytes:
    """How many words fall into each bin, 255 at most; a power of two bins, more for longer texts."""
    bits = min(max(len(words).bit_length() - 2, BINS[0]), BINS[1])
    held = _mix(words.astype(np.uint64) + np.uint64(1)) >> np.uint64(40) & np.uint64((1 << bits) - 1)
    return np.minimum(np.bincount(held.astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def folded(counts: np.ndarray, bins: int) -> np.ndarray:
    """Counts in fewer bins, as ``word_counts`` would give them."""
    return np.minimum(counts.reshape(-1, bins).sum(axis=0, dtype=np.int64), 255).astype(np.uint8) if len(counts) > bins else counts


def edits_allowed(longest, threshold: float):
    """Edits up to which a text of so many words is alike, for numbers and arrays."""
    return np.floor((1 - threshold) * longest + 1e-9).astype(np.int64)


def with_word_counts(words: DataFrame) -> DataFrame:
    """node, words, size, counts: how many words, and in which bins."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("words")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("words"), pa.array([len(x) for x in held], pa.int64()), pa.array([word_counts(x) for x in held], pa.binary())], names=["node", "words", "size", "counts"])

    return words.mapInArrow(work, "node binary, words binary, size long, counts binary")


def verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) whose texts align."""
    left = words.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    right = words.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    # The hub, b, may have very many partners; its words join last, in a join whose partitions can be split.
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("wa"), batch.column("wb")):
                x, y = (np.frombuffer(v.as_buffer(), "<u4") for v in (x, y))
                longest = max(len(x), len(y))
                good.append(longest > 0 and edits_within(x, y, int((1 - threshold) * longest + 1e-9)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.mapInArrow(work, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node in ``edges`` (a, b); root is the least node of its component.

    Every node hooks to its least neighbour, chains are shortened by pointer jumping, and the
    edges between different trees go on. Each round leaves fewer than half of the trees.
    """
    empty = edges.where("false").select(F.col("a").alias("node"), F.col("b").alias("root"))
    edges, rounds = materialise(edges.where("a != b"), "edges"), []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "hooks")
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = materialise(up.join(over, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "jumps")
            up = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        rounds.append(up)
        of_a, of_b = (up.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        crossing = edges.join(of_a, "a").join(of_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a != b")
        edges = materialise(crossing.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if not rounds:
        return empty
    root = rounds[0]
    for up in rounds[1:]:
        later = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
        root = root.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return materialise(root, "roots")


def with_hubs(keyed: DataFrame) -> DataFrame:
    """key, node, least, most, n: the members of buckets of several, the two hubs, and how many members; tables in between go at once.

    No member is left out: ``hub_pairs`` has the pairs with a hub, ``other_pairs`` all others.
    """
    # Tables that are joined are written first: then both sides are dealt anew, and a hot key can be split.
    keyed = materialise(keyed, "keys")
    hubs = materialise(keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).where("least != most"), "hubs")
    held = materialise(keyed.join(hubs, "key"), "held")
    release(keyed, hubs)
    return held


def hub_pairs(held: DataFrame) -> DataFrame:
    """a, b, shared: members and the hubs of their buckets, and how many buckets they meet in so; ``other_pairs`` has the rest."""
    near = held.select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array("least", "most"))).alias("b")).where("a != b")
    return near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))


def alike(pairs: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) whose lengths and word counts do not rule out an alignment, which spares most texts that share but a passage."""
    of = lambda c: counts.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("counts").alias(f"counts_{c}"))
    joined = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "size_a", "counts_a", "size_b", "counts_b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_a, size_b = (batch.column(f"size_{c}").to_numpy() for c in "ab")
            most = edits_allowed(np.maximum(size_a, size_b), threshold)
            good = (np.abs(size_a - size_b) <= most) & (np.maximum(size_a, size_b) > 0)
            for i in np.flatnonzero(good).tolist():
                x, y = (np.frombuffer(batch.column(f"counts_{c}")[i].as_buffer(), np.uint8) for c in "ab")
                x, y = folded(x, len(y)), folded(y, len(x))
                good[i] = int(np.maximum(x, y).sum(dtype=np.int64)) - min(int(x.sum(dtype=np.int64)), int(y.sum(dtype=np.int64))) <= most[i]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.mapInArrow(work, "a binary, b binary")


def other_pairs(held: DataFrame, root: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of one bucket, neither its hub, in different classes, that lengths and word counts do not rule out.

    A bucket of up to BLOCK members is one group; two texts that are in several such are compared in that of least key.
    Members of larger ones meet in ``alike_by_rare_words``, which takes each text once and also finds pairs of different buckets.
    """
    of = root.select("node", F.col("root").alias("of"))
    found = held.join(of, "node", "left").select("key", "node", "least", "most", "n", F.coalesce("of", "node").alias("root"))
    found = materialise(found, "rooted")
    several = found.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    rest = materialise(found.join(several, "key", "left_semi").where("node != least AND node != most").select("key", "node", "root", "n"), "rest")
    small = rest.where(F.col("n") <= BLOCK).groupBy("node", "root").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    small = small.join(texts.select("node", "size", "counts").where("size > 0"), "node")
    dealt = small.select(F.explode("keys").alias("key"), "node", "root", "size", "counts", "keys")
    dealt = dealt.withColumn("keys", F.filter("keys", lambda k: k < F.col("key"))).repartition("key").sortWithinPartitions("key")
    pairs = dealt.mapInArrow(lambda batches: _by_group(batches, "key", lambda group: _group_pairs(group, threshold)), "a binary, b binary")
    large = rest.where(F.col("n") > BLOCK).select("node", "root").distinct()
    if not large.isEmpty():
        large = materialise(large.join(texts.where("size > 0"), "node").select("node", "root", "words", "size", "counts"), "large")
        pairs = pairs.union(alike_by_rare_words(large, threshold))
    release(found)
    return materialise(pairs.distinct(), "others")


def _by_group(batches: Iterator[pa.RecordBatch], column: str, work) -> Iterator[pa.RecordBatch]:
    """``work`` of each run of rows with one value in ``column`` that has more than one row."""
    kept = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        col = table.column(column).to_numpy()
        bounds = [0, *(np.flatnonzero(col[1:] != col[:-1]) + 1).tolist(), len(table)]
        for a, b in zip(bounds, bounds[1:]):
            part = table.slice(a, b - a)
            if kept and len(part) and kept[0].column(column)[0] != part.column(column)[0]:
                if sum(map(len, kept)) > 1:
                    yield from work(pa.concat_tables(kept).combine_chunks())
                kept = []
            kept += [part] if len(part) else []
    if sum(map(len, kept)) > 1:
        yield from work(pa.concat_tables(kept).combine_chunks())


def _class_numbers(roots: pa.ChunkedArray) -> np.ndarray:
    return np.unique(np.array([bytes(x) + b"." for x in roots.to_pylist()]), return_inverse=True)[1]


def _pairs_batch(left: list, right: list) -> pa.RecordBatch:
    both = [(max(x, y), min(x, y)) for x, y in zip(left, right)]
    return pa.RecordBatch.from_arrays([pa.array([x[c] for x in both], pa.binary()) for c in (0, 1)], names=["a", "b"])


def _group_pairs(group: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """The pairs of a group, but for those that are in a group of a lesser key too; ``keys`` has a text's lesser keys."""
    sizes = group.column("size").to_numpy()
    order = np.argsort(sizes, kind="stable")
    sizes, roots = sizes[order], _class_numbers(group.column("root"))[order]
    if roots.min() == roots.max():
        return
    held = group.column("counts").to_pylist()
    counts, nodes = [np.frombuffer(held[k], np.uint8) for k in order.tolist()], group.column("node").to_pylist()
    bins = np.array([len(x) for x in counts])  # in order of length they rise
    # Where the window of each text ends: longer ones that allow for the difference in length.
    ends = np.searchsorted(sizes - edits_allowed(sizes, threshold), sizes, side="right")
    lesser = [np.asarray(x, np.int64) for x in group.column("keys").take(order).to_pylist()]
    owner, listed = np.repeat(np.arange(len(lesser)), [len(x) for x in lesser]), np.concatenate(lesser)
    by_key = np.argsort(listed, kind="stable")
    owner, listed = owner[by_key], listed[by_key]
    met, left, right = np.zeros(len(lesser), bool), [], []
    for level in np.unique(bins).tolist():
        begin, end = int(np.searchsorted(bins, level)), int(np.searchsorted(bins, level, side="right"))
        table = np.stack([folded(x, level) for x in counts[begin : int(ends[begin:end].max())]])
        sums = table.sum(axis=1, dtype=np.int64)
        for k in range(begin, end):
            fit = np.arange(k + 1, ends[k])
            fit = fit[roots[fit] != roots[k]]
            if len(fit) and len(lesser[k]):
                spans = zip(np.searchsorted(listed, lesser[k]).tolist(), np.searchsorted(listed, lesser[k], side="right").tolist())
                met[:] = False
                for a, b in spans:
                    met[owner[a:b]] = True
                fit = fit[~met[fit]]
            if len(fit):
                most = edits_allowed(sizes[fit], threshold)
                over = np.maximum(table[k - begin], table[fit - begin]).sum(axis=1, dtype=np.int32) - np.minimum(sums[k - begin], sums[fit - begin])
                fit = fit[over <= most]
                left += [nodes[order[k]]] * len(fit)
                right += [nodes[order[x]] for x in fit.tolist()]
    if left:
        yield _pairs_batch(left, right)


def how_common(large: DataFrame) -> np.ndarray:
    """For each of 2 ** RANKS hash values of words, how often words with it are in the texts, as four times the logarithm.

    Every text is counted; what a task passes on and what comes to the driver is bounded by the number of hash
    values. One task's counts end at 65,535, which only matters to the order.
    """
    parts, of_part = 64, 1 << RANKS - 6

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RANKS, np.int64)
        for batch in slices(batches, "words", 2 << 20):
            for x in batch.column("words"):
                np.add.at(total, _rank_slot(labelled_runs(np.frombuffer(x.as_buffer(), "<u4").astype(np.uint64), 1)), 1)
        if total.any():
            held = np.minimum(total, 65535).astype("<u2").reshape(parts, of_part)
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([x.tobytes() for x in held], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts")):
                totals[part] = totals.get(part, 0) + np.frombuffer(counts.as_buffer(), "<u2").astype(np.int64)
        for part, total in totals.items():
            level = np.floor(4 * np.log2(total + 1)).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level], pa.binary())], names=["part", "levels"])

    counted = large.select("words").mapInArrow(count, "part int, counts binary")
    out = np.zeros((parts, of_part), np.uint8)
    for row in counted.repartition("part").mapInArrow(add, "part int, levels binary").collect():
        out[row["part"]] = np.frombuffer(bytes(row["levels"]), np.uint8)
    return out.ravel()


def _rank_slot(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - RANKS)).astype(np.int64)


def rare_words(words: np.ndarray, levels: np.ndarray, threshold: float) -> np.ndarray:
    """The rarest words of a text, rarest first, one more than the edits allowed; repeated ones are told apart.

    Of texts that are alike the longer one's words, but for the edits allowed, are in both. In any one order
    the first of these common words comes so early in both texts that it is among these.
    """
    found = labelled_runs(words.astype(np.uint64), 1)
    return found[np.lexsort((found, levels[_rank_slot(found)]))[: int(edits_allowed(len(words), threshold)) + 1]]


def alike_by_rare_words(large: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of any two texts in different classes that lengths and word counts do not rule out.

    Texts that are alike share a rare word. Each text goes once to each group that its rare words
    are dealt to, so its rows are no more than these words, however many texts there are.
    """
    groups = -(-large.count() // GROUP)
    levels = how_common(large)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words", 2 << 20):
            at, group, listed, places, counts = [], [], [], [], []
            for k, (x, y) in enumerate(zip(batch.column("words"), batch.column("counts"))):
                rare = rare_words(np.frombuffer(x.as_buffer(), "<u4"), levels, threshold)
                to = (rare & np.uint64(0xFFFFFFFF)).astype(np.int64) % groups
                order = np.argsort(to, kind="stable")
                own, first = np.unique(to[order], return_index=True)
                at += [k] * len(own)
                group += own.tolist()
                # Half of a word's hash: words taken for one another only add pairs.
                listed += [v.tobytes() for v in np.split((rare[order] >> np.uint64(32)).astype("<u4"), first[1:])]
                places += [v.tobytes() for v in np.split(order.astype("<i4"), first[1:])]
                counts += [folded(np.frombuffer(y.as_buffer(), np.uint8), 1 << BINS[0]).tobytes()] * len(own)
            rows = batch.select(["node", "root", "size"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), *rows.columns, *(pa.array(x, pa.binary()) for x in (listed, places, counts))], names=["group", "node", "root", "size", "rare", "places", "counts"])

    dealt = large.mapInArrow(deal, "group int, node binary, root binary, size long, rare binary, places binary, counts binary")
    dealt = dealt.repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(lambda batches: _by_group(batches, "group", lambda group: _rare_pairs(group, threshold)), "a binary, b binary")


def _rare_pairs(group: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """The pairs of a group that share a rare word dealt to it, from which on they can have enough words in common.

    A text of n words has n - i left from its word of place i on. Where that is the first word that two texts share,
    they have no more in common; so a pair that is alike is found by its first common word, in the group of that.
    """
    group = group.take(np.argsort(group.column("size").to_numpy(), kind="stable"))
    sizes, roots = group.column("size").to_numpy(), _class_numbers(group.column("root"))
    rare, places = ([np.frombuffer(x, kind) for x in group.column(c).to_pylist()] for c, kind in (("rare", "<u4"), ("places", "<i4")))
    row = np.repeat(np.arange(len(rare)), [len(x) for x in rare])
    # By word, and by length where the word is the same.
    word, place = np.concatenate(rare), np.concatenate(places)
    order = np.argsort(word, kind="stable")
    word, place, row = word[order], place[order], row[order]
    begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    several = np.minimum.reduceat(roots[row], begin) != np.maximum.reduceat(roots[row], begin)
    stop = np.append(begin[1:], len(word))
    # Up to which row, in order of length, a text can be alike by this word.
    last = np.searchsorted(sizes - edits_allowed(sizes, threshold), sizes[row] - place, side="right")
    found = {}
    for a, b in zip(begin[several].tolist(), stop[several].tolist()):
        ends = a + np.searchsorted(row[a:b], last[a:b])
        for k in (np.flatnonzero(ends > np.arange(a, b) + 1) + a).tolist():
            found.setdefault(int(row[k]), []).append((k + 1, int(ends[k - a])))
    if not found:
        return
    nodes, held = group.column("node"), group.column("counts")
    table = np.frombuffer(b"".join(held.to_pylist()), np.uint8).reshape(len(held), -1)
    sums = table.sum(axis=1, dtype=np.int64)
    left, right = [], []
    for k, spans in found.items():
        fit = np.unique(np.concatenate([row[a:b] for a, b in spans])) if len(spans) > 1 else row[spans[0][0] : spans[0][1]]
        fit = fit[roots[fit] != roots[k]]
        if len(fit):
            over = np.maximum(table[k], table[fit]).sum(axis=1, dtype=np.int32) - np.minimum(sums[k], sums[fit])
            fit = fit[over <= edits_allowed(sizes[fit], threshold)]
            left += [nodes[k].as_py()] * len(fit)
            right += nodes.take(fit).to_pylist()
            if len(left) > 100_000:
                yield _pairs_batch(left, right)
                left, right = [], []
    if left:
        yield _pairs_batch(left, right)


def classes(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, spent: list[DataFrame] | None = None) -> DataFrame:
    """id, node, root and class_id of every row; node is the MD5 of the text, root the least of the class, both null for null texts.

    ``spent`` gets the table of words, which the result no longer reads, for the caller to release.
    """
    rows = df.select(F.unhex(F.md5(F.col(text_col))).alias("node"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = materialise(sketch_rows(rows), "sketches")
    nodes = sketched.where("node IS NOT NULL").select("node", "keys").dropDuplicates(["node"])
    held = with_hubs(nodes.select("node", F.explode("keys").alias("key")))
    member = materialise(sketched.select("node", "id"), "members")
    release(sketched)
    pairs = materialise(hub_pairs(held), "pairs")
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    # One row of each node; by node and id the copies of one text are spread over tasks.
    one = member.where("node IS NOT NULL").groupBy(F.col("node").alias("_node")).agg(F.min("id").alias("_id"))
    one = materialise(one.join(needed.withColumnRenamed("node", "_node"), "_node", "left_semi"), "needed")
    hashed = word_rows(rows)
    # Asked for, so that the plan is the same whether or not the nodes would fit a broadcast.
    # A key without nulls, by which the join leaves the copies of one row beside each other, so that one of them is kept without another shuffle.
    row_of = lambda df, node, id_: df.withColumn("pick", F.xxhash64(node, id_))
    needed_rows = row_of(one, "_node", "_id").select(F.col("_node").alias("node"), "pick").hint("merge")
    words = row_of(hashed, "node", "id").join(needed_rows, ["node", "pick"], "left_semi").dropDuplicates(["node", "pick"]).select("node", "words")
    texts = materialise(with_word_counts(words), "words")
    release(one)
    counts, words = texts.select("node", "size", "counts"), texts.select("node", "words")
    best = pairs.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    links = materialise(verified(materialise(alike(best, counts, threshold), "alike"), words, threshold), "links")
    first = components(links)
    of_a, of_b = (first.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    apart = pairs.select("a", "b").join(best, ["a", "b"], "left_anti").join(of_a, "a", "left").join(of_b, "b", "left")
    apart = apart.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    more = materialise(verified(materialise(alike(apart, counts, threshold), "alike"), words, threshold), "links")
    root = first if more.isEmpty() else components(links.union(more))
    late = materialise(verified(other_pairs(held, root, texts, threshold), words, threshold), "links")
    release(held, pairs)
    if spent is not None:
        spent.append(texts)
    root = root if late.isEmpty() else components(links.union(more).union(late))
    member = member.join(root, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    named = materialise(member.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("class_id")), "names")
    out = member.join(named, "root", "left")
    return out.select("id", "node", "root", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))


def one_of_each(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """The rows and columns of ``df``, of each class that of least id; rows with a null text all stay.

    Each class keeps one row, also where its ids are null or those of another class.
    """
    found = materialise(classes(df, id_col, text_col, threshold, spent := []), "classes")
    release(*spent)
    keep = found.where("node IS NOT NULL AND id <=> class_id").groupBy("root", "class_id").agg(F.min("node").alias("node"), F.count("*").alias("n"))
    # One key, in which null ids are equal too: copies of a row lie beside each other after the join, so texts are shuffled once.
    key = lambda node, id_: F.struct(node.alias("node"), id_.alias("id"))
    row = df.select(F.struct("*").alias("row"), key(F.unhex(F.md5(F.col(text_col))), F.col(id_col)).alias("key"))
    kept = row.join(keep.select(key(F.col("node"), F.col("class_id")).alias("key")), "key", "left_semi")
    if not keep.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["key"])
    return kept.select("row.*").unionByName(df.where(F.col(text_col).isNull()))
