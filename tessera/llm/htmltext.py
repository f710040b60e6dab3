"""Main text of web pages, by nearest-URL page differencing.

Pages are parsed into lines, one for each block of text, those of menus, footers and adverts
too. For each line that does not stand in the page's own article, the page of the same host
that holds that line too and has most leading segments of the URL path in common is a *mate*.
The lines of a page and of each of its mates are aligned by a longest common subsequence, and
shared lines, which are the site's template, are deleted. Two checks by the page's own marks
follow: lines of its largest ``article`` (else ``main``) are restored, for a passage that two
articles share belongs to both; and what is left of elements that by name, class, id or role
hold no article goes, for a template line that no other page has cannot be told by differencing.

Pages with one title and headline are *twins*: a twin is a mate only where no other page has
the line, and if it then repeats half of the lines or more it is a copy and deletes nothing.
Pages without title and headline are copies if all lines of one are the other's.

Mates are least and greatest page hashes of groups by (host, leading path, line), which are
summed up within tasks before they are shuffled: a line on every page of a hot host costs each
task one row. They do not depend on how the pages are dealt to tasks. Of equally near pages the
least or greatest hash counts. Lines travel as 64-bit hashes; a page's html is read twice, and
is shuffled only if some page has lines that differencing takes and no mark would.

Null or empty html gives an empty text. A page without a mate keeps its unmarked lines; a URL
that can't be parsed has an empty host. Repeated rows are one page. Other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .bpe import slices
from .shared import materialise

#: Bits of the table from which an alignment is read; larger ones are halved first.
TABLE_BITS = 1 << 27

#: Elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript template iframe xmp noembed noframes".split())
DROPPED = frozenset("nav footer aside form button select option menu dialog svg math object audio video canvas datalist fieldset label".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: What an opening tag closes, and where the search for it ends.
CLOSES = {"li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])), "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])), "tr": (frozenset(["tr"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "option": (frozenset(["option"]), frozenset(["select"]))}
#: Words of class, id or role that mark what is no article.
MARKS = frozenset("ad ads adv advert advertisement adverts adsense banner breadcrumb breadcrumbs byline-share comment comments commentlist complementary consent contentinfo cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar tooltip widget".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>?", re.S)
#: After the last ">" nothing is a tag.
TAIL = re.compile(r"<!--.*+|<[!?/][^>]*+", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


@lru_cache(4096)
def unwanted(tag: str, attributes: str) -> bool:
    """Whether an element holds something other than the article."""
    if tag in DROPPED:
        return True
    if not attributes.strip():
        return False
    found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    if tag in ("html", "body", "article", "main", "h1", "h2", "h3"):
        names = re.split(r"[^a-z]+", found.get("class", "") + " " + found.get("id", ""))
        return tag == "article" and ("comment" in names or "comments" in names)
    names = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}"
    return not MARKS.isdisjoint(re.split(r"[^a-z]+", names))


def page_lines(text: str | None) -> tuple[str, list[tuple[str, int]]]:
    """Title and first headline, and lines and their place: above 0 the number of their article, 0 in main, -2 in what is marked as no article, else -1."""
    lines, parts, gone, stack, head = [], [], [], [], ["", ""]
    dropped = articles = at = 0
    inside: list[int] = []

    def flush() -> None:
        for held, place in ((parts, inside[0] if inside else -1), (gone, -2)):
            if held:
                if line := " ".join(html.unescape("".join(held)).split()):
                    lines.append((line, place))
                held.clear()

    def pop(to: int) -> None:
        nonlocal dropped
        for name, drop, place in reversed(stack[to:]):
            dropped -= drop
            open_[name] -= 1
            if place >= 0:
                inside.pop()
        del stack[to:]

    text = text or ""
    last, open_ = text.rfind(">"), Counter()
    while at < len(text):
        m = (TOKEN if at <= last else TAIL).search(text, at)
        (gone if dropped else parts).append(text[at : m.start() if m else len(text)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower() if at <= last + 1 and m.lastindex else ""
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag == "title" and not closing:
            end = re.compile(r"</title\s*/?>", re.I).search(text, at)
            head[0] = head[0] or " ".join(html.unescape(text[at : end.start() if end else len(text)]).split())
            at = end.end() if end else len(text)
            continue
        if tag in BLOCK:
            before = len(lines)
            flush()
            if closing and tag == "h1" and not head[1] and len(lines) > before:
                head[1] = lines[-1][0]
        if closing:
            for i in range(len(stack) - 1, -1, -1) if open_[tag] else ():
                if stack[i][0] == tag:
                    pop(i)
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if tag in VOID:
            continue
        stop, ends = CLOSES.get(tag, ((), ()))
        if tag in BLOCK and not stop:
            stop, ends = ("p",), ("article", "section", "div", "td", "li", "body", "main")
        for i in range(len(stack) - 1, -1, -1) if any(open_[t] for t in stop) else ():
            if stack[i][0] in stop:
                pop(i)
                break
            if stack[i][0] in ends:
                break
        drop = (unwanted if len(attributes) < 1000 else unwanted.__wrapped__)(tag, attributes) or tag == "header" and not inside
        place = -1
        if not drop and not dropped and tag in ("article", "main"):
            if tag == "article":
                articles += 1
            place = articles if tag == "article" else 0
            # An article in an article belongs to it; one in main is told apart.
            inside.append(inside[-1] if inside and inside[-1] > 0 else place)
        stack.append((tag, drop, place))
        open_[tag] += 1
        dropped += drop
    flush()
    return "\0".join(head).strip("\0"), lines


def article_of(lines: list[tuple[str, int]]) -> int | None:
    """The place of the largest article, else of main; None if the page marks none."""
    sizes: dict[int, int] = {}
    for line, place in lines:
        sizes[place] = sizes.get(place, 0) + len(line)
    marked = [p for p in sizes if p > 0] or [p for p in sizes if p == 0]
    return max(marked, key=lambda p: (sizes[p], -p)) if marked else None


def common_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, by bit rows; long lists are halved."""
    both = set(a) & set(b)
    places, b = [i for i, x in enumerate(a) if x in both], [y for y in b if y in both]
    return [places[i] for i in _common([a[i] for i in places], b)]


def _rows(a: list, b: list, keep: bool) -> list[int]:
    """For prefixes of ``b`` (all, or the whole only): bit i is 0 where the subsequence with a[: i + 1] is longer than with a[:i]."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, rows = full, []
    for y in b:
        u = row & masks.get(y, 0)
        row = ((row + u) | (row - u)) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _common(a: list, b: list) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > TABLE_BITS and len(b) > 1:
        half = len(b) // 2
        gains = lambda x, y: [1 - (r >> i & 1) for r in _rows(x, y, False) for i in range(len(x))]
        ahead, behind = [0, *accumulate(gains(a, b[:half]))], [0, *accumulate(gains(a[::-1], b[half:][::-1]))]
        cut = max(range(len(a) + 1), key=lambda i: (ahead[i] + behind[len(a) - i], -i))
        return _common(a[:cut], b[:half]) + [cut + i for i in _common(a[cut:], b[half:])]
    rows = _rows(a, b, True)
    out, i, j = [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:
            i -= 1
        elif j > 0 and not rows[j - 1] >> i & 1:
            j -= 1
        else:
            out.append(i)
            i, j = i - 1, j - 1
    return out[::-1]


def deleted(lines: list[int], mate: list[int], twin: bool, named: bool) -> list[int]:
    """Places of the lines that a mate shares; none if it is a copy."""
    shared = common_lines(lines, mate)
    copy = twin and (2 * len(shared) >= len(lines) if named else len(shared) in (len(lines), len(mate)))
    return [] if copy else shared


def main_text(lines: list[tuple[str, int]], gone: set[int] | frozenset[int] = frozenset()) -> str:
    """The lines of the page's own article, and those that neither differencing nor a mark takes."""
    chosen = article_of(lines)
    return " ".join(line for i, (line, place) in enumerate(lines) if place > -2 and (place == chosen or i not in gone))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages to hashes: the page's (its head's in the upper half), its lines', and those of (leading path, line) outside the article."""
    hashed = lambda *x: _signed(xxhash.xxh64_intdigest("\0".join(x).encode("utf-8", "replace")))
    for batch in slices(batches, "html", 2 << 20):
        out = []
        for key, host, path, text in zip(*(batch.column(c).to_pylist() for c in ("key", "host", "path", "html"))):
            head, lines = page_lines(text)
            chosen = article_of(lines)
            page = _signed((hashed(head) & 0xFFFFFFFF) << 32 | xxhash.xxh32_intdigest(key))
            steps = [s for s in path.split("/") if s][:-1]
            leads = [f"{host}/{'/'.join(steps[:n])}" for n in range(len(steps) + 1)]
            outside = dict.fromkeys(line for line, place in lines if place != chosen)
            places = bytes(0 if place == -2 else 2 if place == chosen else 1 for _, place in lines)
            tiers = [{"k": hashed(lead, line), "line": hashed(line), "depth": n} for line in outside for n, lead in enumerate(leads)]
            out.append({"key": key, "page": page, "named": head != "", "lines": [hashed(line) for line, _ in lines], "places": places, "tiers": tiers})
        yield pa.RecordBatch.from_pylist(out, schema=OUTLINE)


OUTLINE = pa.schema([("key", pa.binary()), ("page", pa.int64()), ("named", pa.bool_()), ("lines", pa.list_(pa.int64())), ("places", pa.binary()), ("tiers", pa.list_(pa.struct([("k", pa.int64()), ("line", pa.int64()), ("depth", pa.int32())])))])


def _keyed(df: DataFrame, url_col: str, html_col: str) -> DataFrame:
    url, text = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    site = r"^[A-Za-z][\w+.-]*://"
    return df.select(F.struct("*").alias("row"), F.unhex(F.md5(F.concat_ws("\n", url, text))).alias("key"), F.lower(F.regexp_extract(url, site + r"(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"), F.regexp_extract(url, site + r"[^/?#]*([^?#]*)", 1).alias("path"), text.alias("html"))


def outlines(df: DataFrame, url_col: str, html_col: str) -> DataFrame:
    rows = _keyed(df, url_col, html_col).select("key", "host", "path", "html").mapInArrow(_outlined, "key binary, page long, named boolean, lines array<long>, places binary, tiers array<struct<k:long,line:long,depth:int>>")
    return materialise(rows, "outlines")


def mates(held: DataFrame) -> DataFrame:
    """page, mate: for each line outside a page's article the nearest page that holds it too."""
    # Distinct within tasks and then over all, so that equal pages are one.
    lines = held.select("page", F.inline("tiers")).select("page", "k", "line", "depth")
    hubs = materialise(lines.groupBy("k").agg(F.min("page").alias("least"), F.max("page").alias("most")).where("least != most"), "hubs")
    of = lambda c: F.shiftright(c, 32)
    mate = F.when(of("least") != of("page"), F.col("least")).when(of("most") != of("page"), F.col("most")).when(F.col("least") != F.col("page"), F.col("least")).otherwise(F.col("most"))
    found = lines.join(hubs, "k").withColumn("mate", mate)
    best = F.min(F.struct((of("mate") == of("page")).alias("twin"), (-F.col("depth")).alias("far"), "mate"))
    return found.groupBy("page", "line").agg(best["mate"].alias("mate")).select("page", "mate").distinct()


def differences(held: DataFrame) -> DataFrame:
    """key, gone, decided of each page: the lines that its mates share, and those of them that no mark settles."""
    # Written first, so that both sides of the join are dealt anew and a page that is many pages' mate can be split.
    arrays = materialise(held.groupBy(F.col("page").alias("mate")).agg(F.min("lines").alias("others")), "arrays")
    pairs = materialise(materialise(mates(held), "mates").join(arrays, "mate"), "mates")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            twin = [(a >> 32) == (b >> 32) for a, b in zip(batch.column("page").to_pylist(), batch.column("mate").to_pylist())]
            gone = [deleted(a.as_py(), b.as_py(), t, n.as_py()) for a, b, t, n in zip(batch.column("lines"), batch.column("others"), twin, batch.column("named"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("places"), pa.array(gone, pa.list_(pa.int32()))], names=["key", "places", "gone"])

    met = pairs.join(held.select("key", "page", "named", "lines", "places"), "page").select("key", "page", "mate", "named", "lines", "others", "places")
    gone = met.mapInArrow(work, "key binary, places binary, gone array<int>").where("size(gone) > 0")
    gone = gone.groupBy("key", "places").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))
    return gone.select("key", "gone", F.filter("gone", lambda i: F.substring("places", i + 1, F.lit(1)) == F.lit(b"\x01")).alias("decided"))


def article_texts(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Id, url and text of every page."""
    held = outlines(df, url_col, html_col)
    decided = materialise(differences(held).where("size(decided) > 0").select("key", F.col("decided").alias("gone")), "decided")
    id_, url = F.col("row").getField(id_col).alias("id"), F.col("row").getField(url_col).alias("url")
    rows = _keyed(df, url_col, html_col).select("key", id_, url, "html").join(decided, "key", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 2 << 20):
            texts = [main_text(page_lines(text.as_py())[1], frozenset(gone.as_py() or ())) for text, gone in zip(batch.column("html"), batch.column("gone"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return rows.select("id", "url", "html", "gone").mapInArrow(work, f"id {kind}, url string, text string").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
