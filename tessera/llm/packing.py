"""Best-fit packing by bin completion.

Documents become token pieces of at most ``capacity``; only the histogram of piece
lengths, which has ``capacity`` entries at any input size, comes to the driver. There
a branch-and-bound search completes bins around the largest length left. Equal bins
form a *run*, so the plan stays small too. Pieces find their place by their rank
within their length, which two levels of counts give without one large sort.

Null text counts as empty: such a document is one piece that holds only the end id.
Repeated rows, ids included, are packed once each. Pieces of one length are told apart by
nothing but their rank by (id, piece, CRC), so equal pieces may change places. Other columns
are ignored, whatever their names; an empty table gives an empty result.

Fewest bins is a hard problem: the plan is proven to be the least where it meets
``lower_bound``; else the search ends after ``SEARCH_STEPS`` with the best plan found, which
is a whole packing and never has more bins than best fit.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import product
from math import isqrt

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import PRETOKEN, BpeEncoder, slices, texts_of
from .shared import hash_bucket, materialise

#: Parts of the ranks of one length, at least; with more pieces than its square, as many as the square root of their number.
RANK_BUCKETS = 256
#: Bins aimed at, by how far they lie between the bound and best fit, and how much more than its share of the free space a bin may then waste.
AIMS, GENEROUS = (1 / 8, 1 / 4, 1 / 2), (1, 1.5, 2, 2.5, 5)
#: Steps (a length looked at) of the search over bins before the best plan so far is taken.
SEARCH_STEPS = 2_000_000


class WordEncoder(BpeEncoder):
    """The same ids; words that are not cached go through a compiled encoder."""

    def __init__(self, path: str):
        super().__init__(path)
        ranks = {x: i for i, x in enumerate(self.raw) if x and i not in self.special.values()}
        self.compiled = tiktoken.Encoding("words", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})

    def _pretoken(self, word: str) -> bytes:
        return array("I", self.compiled.encode_ordinary(word)).tobytes()

    def _after_space(self, word: str) -> bytes:
        return array("I", self.compiled.encode_ordinary(" " + word)).tobytes()


_loaded: dict[str, WordEncoder] = {}


def token_pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32.

    A document of more than ``capacity`` ids is cut from its end into full pieces, so that
    only its first piece may be shorter.
    """
    end = end_id.to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = WordEncoder(tokenizer)
        bpe = _loaded[tokenizer]
        for batch in slices(batches, "text"):
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(texts_of(batch, "text")):
                ids = bpe.encode(text) + end
                total, at = len(ids) // 4, 0
                size = total % capacity or capacity
                for k in range(-(-total // capacity)):
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(memoryview(ids)[4 * at : 4 * (at + size)]))
                    at, size = at + size, capacity
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return rows.mapInArrow(work, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_filling(counts: dict[int, int], room: int, slack: int = 0) -> tuple[int, ...]:
    """Of the fillings of ``room`` that waste at most ``slack`` more than the fullest, the one of the largest lengths; lengths falling.

    Sums that can be reached are bits of one number, to which lengths are added from the
    smallest on (a length that is there n times as 1, 2, 4, ... of it, up to n). So the fullest
    sum is exact, at a cost of one shift for each length and power of two.
    """
    parts = []
    for s in sorted(s for s, n in counts.items() if n > 0 and s <= room):
        n, k = min(counts[s], room // s), 1
        while n > 0:
            k = min(k, n)
            parts.append((s * k, s, k))
            n, k = n - k, 2 * k
    reach, before, full = 1, [], (1 << room + 1) - 1
    for weight, _, _ in parts:
        before.append(reach)
        reach |= reach << weight & full
    high = room
    low = max(0, reach.bit_length() - 1 - slack)
    taken: list[int] = []
    for (weight, s, k), sums in zip(reversed(parts), reversed(before)):
        # Taken if smaller lengths can still bring the sum between low and high.
        if weight <= high and sums & (1 << high - weight + 1) - (1 << max(0, low - weight)):
            taken += [s] * k
            high, low = high - weight, max(0, low - weight)
    return tuple(taken)


def fillings(counts: dict[int, int], room: int, steps: list[int]) -> Iterator[tuple[int, ...]]:
    """The fullest filling, then all others that no exchange of one length for a longer one left over betters.

    Each length looked at takes one from ``steps[0]``; none are found when that is used up.
    """
    first = best_filling(counts, room)
    sizes = sorted((s for s, n in counts.items() if n > 0 and s <= room), reverse=True)
    steps[0] -= len(sizes)
    yield first
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    while stack and steps[0] > 0:
        steps[0] -= 1
        i, left, taken = stack.pop()
        while i < len(sizes) and sizes[i] > left:
            i += 1
        if i < len(sizes):
            s = sizes[i]
            stack += [(i + 1, left - k * s, taken + (s,) * k) for k in range(min(counts[s], left // s) + 1)]
        elif taken != first:
            steps[0] -= len(sizes)
            if not any(x < u <= x + left and counts[u] > taken.count(u) for x in {0, *taken} for u in sizes):
                yield taken


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: for each k, lengths over capacity - k are alone, those over half apart, and the rest of at least k fills what is left."""
    best, sizes = 0, sorted(s for s, n in histogram.items() if n > 0)
    for k in {0, *(s for s in sizes if 2 * s <= capacity)}:
        alone = sum(histogram[s] for s in sizes if s > capacity - k)
        apart = {s: histogram[s] for s in sizes if 2 * s > capacity and s <= capacity - k}
        rest = sum(s * histogram[s] for s in sizes if k <= s and 2 * s <= capacity)
        room = sum((capacity - s) * n for s, n in apart.items())
        best = max(best, alone + sum(apart.values()) + max(0, -(-(rest - room) // capacity)))
    return best


def search_bins(histogram: dict[int, int], capacity: int, most_bins: int, least: int, nodes: int = SEARCH_STEPS) -> list[tuple[tuple[int, ...], int]] | None:
    """The fewest bins below ``most_bins``, deepest first; None if there are none or ``nodes`` steps find none."""
    total = sum(s * n for s, n in histogram.items())
    steps, best = [nodes], None
    left, runs, waste, bins = {s: n for s, n in histogram.items() if n > 0}, [], 0, 0

    def choices() -> Iterator[tuple[tuple[int, ...], int]]:
        first = max(left)
        rest = {s: n - (s == first) for s, n in left.items()}
        for fill in fillings(rest, capacity - first, steps):
            bin_ = tuple(sorted((first, *fill), reverse=True))
            for times in range(min(left[s] // bin_.count(s) for s in set(bin_)), 0, -1):
                yield bin_, times

    levels = [choices()] if left else []
    while levels and steps[0] > 0 and most_bins > least:
        steps[0] -= 1
        if len(runs) == len(levels):  # back from below
            bin_, times = runs.pop()
            for s in bin_:
                left[s] = left.get(s, 0) + times
            waste, bins = waste - times * (capacity - sum(bin_)), bins - times
        bin_, times = next(levels[-1], ((), 0))
        if not times:
            levels.pop()
            continue
        for s in bin_:
            left[s] -= times
            if not left[s]:
                del left[s]
        runs.append((bin_, times))
        waste, bins = waste + times * (capacity - sum(bin_)), bins + times
        if not left:
            if bins < most_bins:
                most_bins, best = bins, list(runs)
        elif -(-(total + waste) // capacity) < most_bins:
            levels.append(choices())
    return best


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing, bin by bin: the largest length that fits, again and again."""
    left, runs = sorted((s, n) for s, n in histogram.items() if n > 0), []
    sizes, counts = [s for s, _ in left], dict(left)
    while sizes:
        bin_, room, times, at = [], capacity, counts[sizes[-1]], len(sizes)
        while at := bisect_right(sizes, room, 0, at):
            s = sizes[at - 1]
            k = min(counts[s], room // s)
            bin_ += [s] * k
            room, times, at = room - k * s, min(times, counts[s] // k), at - 1
        for s in set(bin_):
            counts[s] -= times * bin_.count(s)
        sizes = [s for s in sizes if counts[s]]
        runs.append((tuple(bin_), times))
    return runs


def complete(histogram: dict[int, int], capacity: int, most_bins: int, bins_aimed: int, generous: float) -> list[tuple[tuple[int, ...], int]] | None:
    """Bins completed around the largest length left; None as soon as they can't be fewer than ``most_bins``.

    Each bin may waste ``generous`` times its share of what ``bins_aimed`` bins would leave free
    in all; the more it may, the larger are the lengths it takes.
    """
    left, runs, bins, waste = {s: n for s, n in histogram.items() if n > 0}, [], 0, 0
    total = sum(s * n for s, n in histogram.items())
    while left:
        first = max(left)
        left[first] -= 1
        share = (bins_aimed * capacity - total - waste) / max(1, bins_aimed - bins)
        fill = best_filling(left, capacity - first, max(0, int(generous * share)))
        left[first] += 1
        bin_ = tuple(sorted((first, *fill), reverse=True))
        times = min(left[s] // bin_.count(s) for s in set(bin_))
        for s in bin_:
            left[s] -= times
            if not left[s]:
                del left[s]
        runs.append((bin_, times))
        bins, waste = bins + times, waste + times * (capacity - sum(bin_))
        if left and -(-(total + waste) // capacity) >= most_bins:
            return None
    return runs if bins < most_bins else None


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, how many such bins), few bins in all.

    Best-fit decreasing gives the incumbent. Bin completion fills around the largest length
    left, as often as the filling can be had, and stops as soon as the waste so far allows
    no fewer bins than the incumbent has; plans that let a bin waste its share take large
    lengths early and keep small ones for the end. Where that leaves more bins than ``lower_bound``
    proves needed, ``search_bins`` goes back to the other undominated fillings.
    """
    count = lambda runs: sum(n for _, n in runs)
    least, best = lower_bound(histogram, capacity), best_fit(histogram, capacity)
    between = count(best) - least
    for aim, generous in [(0, 0), *product(AIMS, GENEROUS)]:
        if count(best) > least and (better := complete(histogram, capacity, count(best), least - int(-aim * between // 1), generous)):
            best = better
    if count(best) > least and (better := search_bins(histogram, capacity, count(best), least)):
        best = better
    return best


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to rows of (id, piece, start, length, ids_crc32)."""
    # So neither a bucket nor the list of a length's buckets becomes large.
    bucket = hash_bucket(max(RANK_BUCKETS, isqrt(pieces.count())), "id", "piece", "ids_crc32")
    pieces = pieces.withColumn("bucket", bucket)
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # For each length, where in its ranks each run begins: at most `capacity` lengths and few runs.
    taken, base, table = dict.fromkeys(histogram, 0), 0, []
    for bin_, times in plan_bins(histogram, capacity):
        offset = 0
        for s in sorted(set(bin_), reverse=True):
            table.append((s, taken[s], base, bin_.count(s), offset))
            taken[s] += times * bin_.count(s)
            offset += s * bin_.count(s)
        base += times
    table.sort()
    lengths, starts, bases, copies, offsets = (np.array(x, np.int64) for x in (zip(*table) if table else [()] * 5))
    keys = (lengths << 48) | starts

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(inside) - 1).join(counts, ["length", "bucket"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = np.searchsorted(keys, (length << 48) | rank, "right") - 1
            within, share = (rank - starts[run], copies[run]) if len(run) else (rank, rank)
            columns = [*batch.columns[:5], pa.array(bases[run] + within // share if len(run) else within), pa.array(offsets[run] + within % share * length if len(run) else within)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = pieces.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed_documents(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    pieces = materialise(token_pieces(df, id_col, text_col, tokenizer, end_id, capacity), "pieces")
    return pack(pieces, capacity).withColumnRenamed("id", id_col)
