"""Secret scans: keyword automaton, anchored patterns near hits, embedded checksums.

An Aho-Corasick automaton over lower-cased text finds the keywords of all kinds in one
pass; a kind's pattern is tried only where one of its keywords begins, from left to
right, and never inside an earlier match of that kind. Patterns read a run of characters
once, so time grows in proportion to the text. Kinds with a built-in checksum or
structure keep a match only if that holds. Long hexadecimal runs have no keyword and are
found by their own scan. Positions are code points, ends exclusive.

Null text counts as empty and has no spans; repeated rows give repeated rows; a null id
stays null; other columns are ignored, whatever their names; an empty table gives an empty
result. Of matches of one kind that begin at one place there is only one.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import slices, texts_of

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def crc32_suffix(token: str) -> bool:
    """Prefixed tokens whose last six characters are the CRC-32 of the 30 before, in base 62."""
    body, crc, digits = token[-36:-6], 0, ""
    crc = zlib.crc32(body.encode())
    while crc:
        crc, d = divmod(crc, 62)
        digits = BASE62[d] + digits
    return token[-6:] == digits.rjust(6, "0")


def base58_check(token: str) -> bool:
    n = 0
    for c in token:
        n = n * 58 + BASE58.index(c)
    data = n.to_bytes(-(-n.bit_length() // 8), "big")
    return len(data) > 4 and hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def bech32_check(token: str) -> bool:
    """The polynomial checksum over the lower-cased prefix and data of a bech32 string."""
    prefix, _, data = token.lower().rpartition("1")
    if any(c not in BECH32 for c in data):
        return False
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    check = 1
    for v in values:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    return check == 1


def jwt_structure(token: str) -> bool:
    try:
        head, body, _ = (base64.urlsafe_b64decode(p + "=" * (-len(p) % 4)) for p in token.split("."))
        return "alg" in json.loads(head) and isinstance(json.loads(body), dict)
    except (ValueError, TypeError, RecursionError):  # no base64, no JSON, a head that is a number, brackets without end
        return False


def pem_structure(block: str) -> bool:
    """The body decodes to one DER sequence of the length that it states."""
    try:
        der = base64.b64decode("".join(block.split("-----")[2].split()), validate=True)
    except ValueError:
        return False
    if len(der) < 2 or der[0] != 0x30:
        return False
    if der[1] < 0x80:
        return len(der) == 2 + der[1]
    n = der[1] & 0x7F
    return 0 < n < 5 and len(der) == 2 + n + int.from_bytes(der[2 : 2 + n], "big")


#: Kind: keywords (lower case), pattern that begins with one of them, test of a match. In the order of output.
KINDS: dict[str, tuple[tuple[str, ...], str, Callable[[re.Match], bool]]] = {
    "assign": (("password", "passwd", "secret", "token", "api_key", "apikey"), r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
    "access": (("akia",), r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": ((), r"[0-9a-f]{24,}", lambda m: True),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])", lambda m: crc32_suffix(m[0])),
    "npm": (("npm_",), r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])", lambda m: crc32_suffix(m[0])),
    "xprv": (("xprv",), r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])", lambda m: base58_check(m[0])),
    "age": (("age-secret-key-1",), r"AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}(?![0-9A-Za-z])", lambda m: bech32_check(m[0])),
    "jwt": (("eyj",), r"(?<![\w-])eyJ[\w-]++\.eyJ[\w-]++\.[\w-]+", lambda m: jwt_structure(m[0])),
    "pem": (("-----begin ",), r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----", lambda m: pem_structure(m[0])),
}
BASE_KINDS = ("assign", "access", "hex")


class Scanner:
    def __init__(self):
        self.kinds = [(name, re.compile(pattern, re.ASCII), test) for name, (_, pattern, test) in KINDS.items()]
        self.automaton, self.unkeyed = ahocorasick.Automaton(), []
        for i, (keywords, _, _) in enumerate(KINDS.values()):
            for k in keywords:
                self.automaton.add_word(k, (len(k), i))
            if not keywords:
                self.unkeyed.append(i)
        self.automaton.make_automaton()

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, kind's place in KINDS, end), sorted."""
        if not text:
            return []
        found, ends = [], [0] * len(self.kinds)
        lower = text.lower()
        if len(lower) != len(text):  # only this letter grows when it is lower-cased
            lower = text.replace("İ", "i").lower()
        # No keyword of a kind lies in another, so their ends come in the order of their starts.
        for end, (size, kind) in self.automaton.iter(lower):
            start = end - size + 1
            if start < ends[kind]:
                continue
            _, pattern, test = self.kinds[kind]
            if m := pattern.match(text, start):
                ends[kind] = m.end()
                if test(m):
                    found.append((start, kind, m.end()))
        for kind in self.unkeyed:
            found += [(m.start(), kind, m.end()) for m in self.kinds[kind][1].finditer(text) if self.kinds[kind][2](m)]
        return sorted(found)


_scanner: list[Scanner] = []


def secret_spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and spans: an array of (kind, start, end) by start, then by kind in the order of KINDS."""
    names = list(KINDS)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner())
        scan = _scanner[0].spans
        for batch in slices(batches, "text"):
            spans = [[{"kind": names[k], "start": s, "end": e} for s, k, e in scan(t)] for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, span)], names=["id", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return rows.mapInArrow(work, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_col)


def without_secrets(df: DataFrame, text_col: str, mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every secret of a text replaced by ``mask``.

    Overlapping spans are masked as one. Rows without a secret stay as they are, null texts too.
    """
    names = df.columns
    at = names.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner())
        for batch in slices(batches, names[at]):
            out = []
            for text in texts_of(batch, names[at]):
                if spans := _scanner[0].spans(text):
                    parts, done = [], 0
                    for start, _, end in spans:
                        if start >= done:
                            parts += [text[done:start], mask]
                        done = max(done, end)
                    text = "".join([*parts, text[done:]])
                out.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(work, df.schema)


def span_digests(spans: DataFrame, id_col: str) -> DataFrame:
    """Counts of the base kinds, the digest of their spans and all spans as text."""
    joined = lambda xs: F.concat_ws(",", F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return spans.select(id_col, *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
