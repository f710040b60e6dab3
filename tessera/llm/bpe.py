"""Byte-level BPE by backtracking over longest matches.

A pre-token is segmented left to right with the longest vocabulary entry that an
Aho-Corasick automaton found at each position. A token may follow another only if
the two are *compatible*: merging their joint bytes by rank would never cross the
seam. Where no compatible token fits, the last one is taken back and its position
is marked dead, so every position is visited a bounded number of times and the
result is the one that applying the merges in order gives. Decoding gathers bytes
through an offset table.

Texts: null counts as empty and gives no ids. Nothing is cut or normalised.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pre-tokenizer's pattern of byte-level BPE vocabularies of this kind.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the word cache of a Python worker, and the longest word that it keeps.
CACHE_WORDS, CACHE_CHARS = 180_000, 48


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    """Ids (little-endian uint32 bytes) of words; a full generation becomes the old one, so frequent words stay."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        if (ids := self.old.get(word)) is None:
            ids = self.encode(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class BpeEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        raw: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            raw[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.raw = raw
        ordinary = {t: i for t, i in vocab.items() if t not in self.special}
        # When a token is born (-1: a single byte), of what, and what each pair makes.
        self.born, self.parts, self.joined = [-1] * self.size, [None] * self.size, {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.joined.setdefault((left, right), (rank, made))
            if self.parts[made] is None:
                self.born[made], self.parts[made] = rank, (left, right)
        self.automaton = ahocorasick.Automaton()
        for token, i in ordinary.items():
            self.automaton.add_word(raw[i].decode("latin-1"), (len(raw[i]), i))
        self.automaton.make_automaton()
        by_bytes = {raw[i]: i for i in ordinary.values()}
        self.tokens = {k.decode("latin-1"): i for k, i in by_bytes.items()}
        self.most = max(map(len, by_bytes))
        #: The next shorter token that begins a token.
        self.shorter = [-1] * self.size
        for i in ordinary.values():
            for n in range(len(raw[i]) - 1, 0, -1):
                if (j := by_bytes.get(raw[i][:n])) is not None:
                    self.shorter[i] = j
                    break
        self.length = [len(x) for x in raw]
        self.compatible: dict[int, bool] = {}
        self.pretoken = regex.compile(PRETOKEN)
        self.split_gap = regex.compile(r"\s \s")
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.spaced, self.single = _Words(self._after_space), _Words(self._pretoken)
        self.whole = {raw[i].decode(): i.to_bytes(4, "little") for i in ordinary.values() if self._is_text(raw[i])}
        self.offsets = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        digits = np.array([f"{i},".encode() for i in range(self.size)])
        self.digits = digits.view(np.uint8).reshape(self.size, -1)

    def fits(self, a: int, b: int) -> bool:
        """Whether merging by rank keeps a seam between ``a`` and ``b``.

        Undo merges at the seam from the latest to the earliest. The seam is crossed if, at
        some point, its two sides merge before what has just been undone: strictly before
        for the left side, and not after for the right, as equal ranks merge from the left.
        """
        key = a << 20 | b
        limit, ok = float("inf"), True
        while True:
            made = self.joined.get((a, b))
            if made is not None and made[0] < limit:
                ok = False
                break
            born_a, born_b = self.born[a], self.born[b]
            if born_a < 0 and born_b < 0:
                break
            if born_a > born_b:
                limit, a = born_a, self.parts[a][1]
            else:
                limit, b = born_b + 1, self.parts[b][0]
        if len(self.compatible) > 400_000:
            self.compatible.clear()
        self.compatible[key] = ok
        return ok

    @staticmethod
    def _is_text(data: bytes) -> bool:
        try:
            return bool(data.decode())
        except UnicodeDecodeError:
            return False

    def _pretoken(self, word: str) -> bytes:
        if (known := self.whole.get(word)) is not None:
            return known
        data = word.encode("utf-8", "surrogatepass")
        n, text = len(data), data.decode("latin-1")
        if n == 0:
            return b""
        longest, compatible, length, shorter = self._longest, self.compatible, self.length, self.shorter
        out, dead, pos, last, token = [], (), 0, -1, longest(text, 0)
        while True:
            while token >= 0:
                if not dead or pos + length[token] not in dead:
                    if last < 0:
                        break
                    if (ok := compatible.get(last << 20 | token)) is None:
                        ok = self.fits(last, token)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos += length[token]
                if pos == n:
                    return array("I", out).tobytes()
                last, token = token, longest(text, pos)
            else:
                dead = dead or set()
                dead.add(pos)
                token = out.pop()
                pos -= length[token]
                last = out[-1] if out else -1

    def _longest(self, text: str, pos: int) -> int:
        """The longest token that begins at ``pos``: the automaton's path from its root, then back to a key."""
        rest = text[pos : pos + self.most]
        size, tokens = self.automaton.longest_prefix(rest), self.tokens
        while (token := tokens.get(rest[:size])) is None:
            size -= 1
        return token

    def _after_space(self, word: str) -> bytes:
        """Of a space and ``word``, which has no space."""
        first, *rest = self.pretoken.findall(" " + word)
        if not rest:
            return self._pretoken(first)
        head = self.spaced[first[1:]] if len(first) > 1 else self.single[first]
        return head + b"".join(map(self.single.__getitem__, rest))

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self.split_gap.search(text):  # a run of white space that parting at spaces would tear
            return b"".join(map(self.single.__getitem__, self.pretoken.findall(text)))
        first, *rest = text.split(" ")
        head = b"".join(map(self.single.__getitem__, self.pretoken.findall(first)))
        return head + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian uint32 bytes."""
        if not text:
            return b""
        if self.split_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._plain(p) for p in self.split_special.split(text))

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.offsets[ids] - (ends - sizes), sizes) + np.arange(total)
        return self.blob[at].tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.digits[ids].tobytes().translate(None, b"\0")[:-1]


_loaded: dict[str, BpeEncoder] = {}


def encoder(path: str) -> BpeEncoder:
    """One encoder a worker and file."""
    if path not in _loaded:
        _loaded[path] = BpeEncoder(path)
    return _loaded[path]


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[str | None]:
    """Strings of a batch, one at a time, without a list of them all."""
    return (x.as_py() for x in batch.column(column))


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most`` bytes, or a single row, in each."""
    for batch in batches:
        sizes = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)))
        start = 0
        while start < batch.num_rows:
            floor = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, floor + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def token_digests(df: DataFrame, id_col: str, text_col: str, tokenizer: str) -> DataFrame:
    """Encode and decode every text: its id, n_tokens, ids_sha256 and decoded_sha256.

    Null and empty texts have 0 tokens and the digests of an empty string; repeated rows
    give repeated rows; a null id stays null; other columns are ignored; an empty table
    gives an empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in slices(batches, "text"):
            counts, hashed, decoded = [], [], []
            for text in texts_of(batch, "text"):
                ids = np.frombuffer(bpe.encode(text), "<u4").astype(np.int64)
                counts.append(len(ids))
                hashed.append(hashlib.sha256(bpe.decimal(ids)).hexdigest())
                back = bpe.decode(ids).decode("utf-8", "replace")
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(hashed), pa.array(decoded)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return rows.mapInArrow(work, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
