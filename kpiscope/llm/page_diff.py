"""Main text of web pages by differencing each page with those of the nearest URLs.

Pages of a host are ordered by URL path. Each page is paired with the two nearest pages before it and
the two nearest after it, all of its host; pages that copy it (most of its text is
shared) are passed over, up to ``REACH`` pages away. Pages become lines, their text blocks in
order, and are aligned with each pair by a longest common subsequence. What the site's template
repeats is shared with most pairs (with all, if they are two or one), and these lines are deleted:

* outside an explicit article or main element, lines shared with most pairs;
* inside one, lines shared with most pairs at the same place there, counted from the start
  or the end of the article, that do not end as a sentence: a label that each
  article carries. A passage that articles quote, or that stands elsewhere there, is content and stays.

Markup is a prior: blocks inside menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments go in any case, as their text may change from page to page. Within an article a class name
like "related" or "search" only makes an element doubtful: it stays if it holds six words or more that end as a sentence. Where
an article or main element holds most of what is left, lines outside it go as well.

Character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by a blank line. Null html counts as empty; a null url is a host and path of
its own, both empty. Equal urls are ordered by page_id as text, then by the html's hash; rows alike in all
of these are copies of each other and stay in one range. A host's only page has no pair. Very long
pages are aligned in linear space. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kpiscope.llm.common import materialise, require_columns

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template svg iframe object canvas audio video head title textarea select button datalist".split())
#: Without an end tag these reach to the end of the page; the others then count as a plain tag.
TO_THE_END = frozenset("script style textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are followed on the stack (others neither hold nor end a region).
HELD = frozenset("article aside details dialog div fieldset figure footer form header main menu nav ol search section table td th tr ul li span p blockquote".split())
VOID_LIKE = frozenset({"p", "li", "span", "td", "th", "tr"})
AWAY = frozenset({"nav", "footer", "aside", "form", "menu", "dialog", "search", "header"})
ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"})
HINTS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner sidebar menu navbar nav navigation breadcrumb breadcrumbs "
    "footer cookie cookies consent notice notices alert popup modal overlay comment comments reply replies disqus share sharing "
    "social related recommended newsletter subscribe subscription signup login search widget pagination pager masthead topbar".split()
)
_OPEN = re.compile(r"<!--|<[!?]|<([a-zA-Z][^\s/>]*+)")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+>?", re.I) for name in RAW}
#: Quotes hold a value, with any characters, after an equals sign only; one that is never closed is a character.
_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)((?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORDS = re.compile(r"[a-z0-9]+")
#: PROSE: a MAIN line that ends as a sentence. From DOUBT on: the MAIN lines of an element with a hint.
OUT, PLAIN, MAIN, PROSE, DOUBT = 0, 1, 2, 3, 8
#: Hints that hold in an article as well, whatever the element says.
HARD = frozenset("ad ads advert adverts advertisement sponsor sponsored comment comments reply replies disqus cookie cookies consent".split())
#: Pages paired with on each side.
SIDE = 2
#: How far a pair may be away, in pages of the url order.
REACH = 8
#: A pair is a copy if it has more than this share of the article's text, or, on pages without
#: such an element, of all text, of which the template may be the most.
COPY_SHARE = {MAIN: 0.5, PLAIN: 0.8}
#: Pages are dealt into ranges of about this much html; beyond ``MAX_RANGES`` ranges grow instead,
#: which bounds the bounds sent to the executors (three keys a range). A range is a sorted stream,
#: of which a task holds 2 x REACH pages.
RANGE_BYTES, MAX_RANGES = 16 << 20, 4096


def hinted(attrs: str, inside: bool) -> int:
    """Whether class, id, role or style mark an element as no part of the main text: 2 yes, 1 in doubt.

    Within an article (``inside``) only whole class names count, and but for HARD ones they are in doubt; outside it
    the words of class names do. An id counts as a whole only.
    """
    if "=" not in attrs:
        return 2 if re.search(r"(?:^|\s)hidden(?:\s|/|$)", attrs) else 0
    doubt = 0
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "class":
            whole = set(value.split())
            if not HARD.isdisjoint(whole) or not inside and not HINTS.isdisjoint(_WORDS.findall(value)):
                return 2
            doubt = doubt or int(not HINTS.isdisjoint(whole))
        elif name == "id":
            if value.strip() in (HARD if inside else HINTS):
                return 2
        elif name == "role":
            if value in ROLES and not inside:
                return 2
        elif name == "aria-hidden":
            if value == "true":
                return 2
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            return 2
    return doubt


def ends(text: str) -> bool:
    """Whether a line ends as a sentence does."""
    return text.rstrip("\"')]»”’")[-1:] in tuple(".!?…")


def is_prose(text: str) -> bool:
    return text.count(" ") >= 5 and ends(text)


def without_raw(page: str) -> str:
    """The page without comments, declarations and raw elements. A raw element's name ends at
    white space, ``/`` or ``>``; names that only begin like one are other elements."""
    out, at, unclosed = [], 0, set()
    find = _OPEN.search
    m = find(page)
    while m:
        end = m.end()
        if m[0] == "<!--":
            stop = page.find("-->", end)
            stop = len(page) if stop < 0 else stop + 3
        elif m[1] is None:
            stop = page.find(">", end) + 1
            if not stop:
                break
        else:
            name, stop = m[1].lower(), 0
            tag = _TAG.match(page, m.start())
            if tag:
                end = tag.end()  # what its attributes hold is no markup
            if name in RAW and name not in unclosed:
                # A self-closing tag holds nothing.
                if tag and page[end - 2] == "/" and name not in TO_THE_END:
                    stop = end
                elif close := _CLOSE[name].search(page, end):
                    stop = close.end()
                else:
                    unclosed.add(name)
                    stop = len(page) if name in TO_THE_END else 0
        if stop:
            out.append(page[at : m.start()])
            at = stop
        m = find(page, max(stop, end))
    out.append(page[at:])
    return "".join(out)


def lines_of(page: str) -> list[tuple[int, str]]:
    """The text blocks in order, each with its region: OUT, PLAIN or MAIN."""
    page = without_raw(page)
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # element, region it began
    region, at, doubts = PLAIN, 0, 0

    def close() -> None:
        if held:
            text = " ".join(html_lib.unescape("".join(held)).split())
            if text:
                out.append((region, text))
            held.clear()

    for m in _TAG.finditer(page):
        name = m[2].lower()
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCKS:
            close()
        if name not in HELD or m[3].endswith("/"):
            continue
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if region != OUT or name not in VOID_LIKE or i == len(stack) - 1:
                        new = stack[i - 1][1] if i else PLAIN
                        if new != region:
                            close()
                        region = new
                        del stack[i:]
                    break
                if name in VOID_LIKE and stack[i][0] not in VOID_LIKE:
                    break  # a stray end of a small element does not end larger ones
            continue
        inside = region >= MAIN
        new = region
        if name in ("article", "main"):
            # An article within a menu or advert that was never closed ends it; one within
            # the comments is a comment.
            new = OUT if hinted(m[3], True) == 2 or any(n == "#comments" for n, _ in stack) else MAIN
        elif region != OUT:
            hint = hinted(m[3], inside)
            if (name in AWAY and not (inside and name == "header")) or hint == 2 or hint and not inside:
                new = OUT
            elif hint:
                doubts += 1
                new = DOUBT + doubts
        if name in VOID_LIKE and stack and stack[-1][0] == name:
            stack.pop()  # the next paragraph, item or cell ends the one before
            if region == OUT and name != "span" and not hinted(m[3], inside) == 2:
                base = stack[-1][1] if stack else PLAIN
                new = base
        if new != region:
            close()
        label = "#comments" if new == OUT and region != OUT and re.search(r"comment|repl(?:y|ies)|disqus", m[3].lower()) else name
        if label == "#comments":
            stack.append((label, OUT))
        stack.append((name, new))
        region = new
    held.append(page[at:])
    close()
    # An element in doubt is the article's if it says something.
    said = {r for r, t in out if r >= DOUBT and is_prose(t)}
    settled = ((MAIN if r in said else OUT) if r >= DOUBT else r for r, _ in out)
    return [(PROSE if r == MAIN and ends(t) else r, t) for r, (_, t) in zip(settled, out)]


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with each prefix of ``b``."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        grown = row[:-1] + (b == x)
        np.maximum(row[1:], grown, out=row[1:])
        np.maximum.accumulate(row, out=row)
    return row


def _align(a: np.ndarray, b: np.ndarray, i0: int, j0: int, out: list[tuple[int, int]]) -> None:
    """Pairs of a longest common subsequence in linear space: split ``a`` in the middle and
    ``b`` where the halves' lengths add up to the most."""
    while len(a) and len(b):
        head = int(np.argmin(np.append(a[: len(b)] == b[: len(a)], False)))
        out.extend((i0 + k, j0 + k) for k in range(head))
        a, b, i0, j0 = a[head:], b[head:], i0 + head, j0 + head
        if not len(a) or not len(b):
            return
        if len(a) == 1:
            at = np.flatnonzero(b == a[0])
            if len(at):
                out.append((i0, j0 + int(at[0])))
            return
        mid = len(a) // 2
        total = _scores(a[:mid], b) + _scores(a[mid:][::-1], b[::-1])[::-1]
        k = int(np.argmax(total))
        _align(a[:mid], b[:k], i0, j0, out)
        a, b, i0, j0 = a[mid:], b[k:], i0 + mid, j0 + k


def common_lines(mine: Sequence[int], other: Sequence[int]) -> list[tuple[int, int]]:
    """Places (mine, other's) of a longest common subsequence, in order."""
    if set(mine).isdisjoint(other):
        return []
    a, b = np.asarray(mine, np.int64), np.asarray(other, np.int64)
    n, tail = min(len(a), len(b)), 0
    while tail < n and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    # Lines that the other side lacks cannot be common.
    ia = np.flatnonzero(np.isin(a[: len(a) - tail], b[: len(b) - tail]))
    ib = np.flatnonzero(np.isin(b[: len(b) - tail], a[: len(a) - tail]))
    got: list[tuple[int, int]] = []
    _align(a[ia], b[ib], 0, 0, got)
    return [(int(ia[i]), int(ib[j])) for i, j in got] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


@dataclass(frozen=True)
class Page:
    """What a page's pairs need of it: its lines' hashes, regions and lengths."""

    host: str
    hashes: Sequence[int]
    regions: bytes
    sizes: Sequence[int]

    @cached_property
    def places(self) -> dict[int, tuple[int, int]]:
        """Each main line's number from the start and from the end of the main lines."""
        at = [i for i, r in enumerate(self.regions) if r >= MAIN]
        return {i: (k, len(at) - k) for k, i in enumerate(at)}

    @cached_property
    def best(self) -> int:
        return min(max(self.regions, default=OUT), MAIN)

    @cached_property
    def size(self) -> int:
        return sum(n for n, r in zip(self.sizes, self.regions) if min(r, MAIN) == self.best)

    def shared(self, other: Page) -> dict[int, int]:
        """My lines that are aligned with the other's, by place."""
        return dict(common_lines(self.hashes, other.hashes))

    def copied(self, shared: dict[int, int]) -> bool:
        same = sum(self.sizes[i] for i in shared if min(self.regions[i], MAIN) == self.best)
        return self.best != OUT and same > COPY_SHARE[self.best] * self.size


def line_hashes(lines: Sequence[tuple[int, str]]) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(t, 0) - (1 << 63) for _, t in lines]


def page_of(lines: Sequence[tuple[int, str]], host: str = "") -> Page:
    return Page(host, line_hashes(lines), bytes(r for r, _ in lines), [len(t) for _, t in lines])


def pairs_with(page: Page, near: Sequence[Page]) -> list[tuple[Page, dict[int, int]]]:
    """The nearest pages of the same host that are no copies, and the lines shared with each."""
    out: list[tuple[Page, dict[int, int]]] = []
    for other in near[:REACH]:
        if other.host != page.host or len(out) == SIDE:
            break
        shared = page.shared(other)
        if not page.copied(shared):
            out.append((other, shared))
    return out


def kept_lines(page: Page, before: Sequence[Page], after: Sequence[Page]) -> list[int]:
    """Places of the main text's lines, given the pages around, nearest first."""
    pairs = pairs_with(page, before) + pairs_with(page, after)
    most = len(pairs) if len(pairs) < 3 else len(pairs) // 2 + 1

    def template(i: int) -> bool:
        if not pairs or page.regions[i] == PROSE:
            return False
        there = [(other, shared[i]) for other, shared in pairs if i in shared]
        if page.regions[i] != MAIN:
            return len(there) >= most
        if len(pairs) < 2:
            return False
        places = [other.places[k] for other, k in there if k in other.places]
        return any(sum(x[end] == page.places[i][end] for x in places) >= most for end in (0, 1))

    left = [i for i, r in enumerate(page.regions) if r != OUT and not template(i)]
    main = sum(page.sizes[i] for i in left if page.regions[i] >= MAIN)
    if main and 2 * main >= sum(page.sizes[i] for i in left):
        left = [i for i in left if page.regions[i] >= MAIN]
    return left


def host_and_path(url: Column) -> tuple[Column, Column]:
    raw = F.coalesce(url, F.lit(""))
    return F.lower(F.regexp_extract(raw, r"(?s)^.*?://([^/?#]*)", 1)), F.regexp_extract(raw, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


KEY = ("host", "path", "full", "id", "mark")


def range_bounds(keyed: DataFrame, n: int) -> list[tuple[tuple, tuple, tuple]]:
    """For each of n ranges of equally many pages: its first key, and those of the pages REACH
    before it and REACH after its last. Only keys are sorted, and 3 x n of them come back."""
    sorted_keys = keyed.select(*KEY).repartitionByRange(n, *KEY).sortWithinPartitions(*KEY)
    rows = materialise(sorted_keys.withColumn("row", F.monotonically_increasing_id()), "page-keys")
    counts = rows.groupBy(F.shiftright("row", 33).alias("part")).count().orderBy("part").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((total, r["part"], r["count"]))
        total += r["count"]
    firsts = [s for s, _, _ in starts]

    def row_of(place: int) -> int:
        start, part, _ = starts[bisect_right(firsts, place) - 1]
        return (part << 33) + place - start

    wanted = [(row_of(s), row_of(max(s - REACH, 0)), row_of(min(s + c - 1 + REACH, total - 1))) for s, _, c in starts]
    ids = sorted({i for w in wanted for i in w})
    chosen = rows.sparkSession.createDataFrame([(i,) for i in ids], "row long")
    got = {r["row"]: tuple(r[c] for c in KEY) for r in rows.join(F.broadcast(chosen), "row").collect()}
    return [tuple(got[i] for i in w) for w in wanted]


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", ranges: int | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each page.

    One shuffle of the parsed pages into ranges of (host, path, url, id), so a host of a third
    of all pages is split like any other. Ranges overlap by ``REACH`` pages at each end, so pairs
    do not depend on where ranges begin. Before it, the keys alone are sorted to find the bounds.
    """
    require_columns(pages, [page_id, url, html])
    spark = pages.sparkSession
    of_url, markup = F.col(f"`{url}`").cast("string"), F.col(f"`{html}`").cast("string")
    host, path = host_and_path(of_url)
    # Strings compare by their UTF-8 bytes in Spark and by code points in Python, which is the same.
    keyed = pages.select(
        host.alias("host"), path.alias("path"), F.coalesce(of_url, F.lit("")).alias("full"), F.coalesce(F.col(f"`{page_id}`").cast("string"), F.lit("")).alias("id"),
        F.xxhash64(markup).alias("mark"), F.col(f"`{page_id}`").alias("page_id"), of_url.alias("url"), markup.alias("html"),
    )
    if ranges is None:
        size = keyed.agg(F.sum(F.octet_length("html"))).first()[0] or 0
        ranges = max(1, min(MAX_RANGES, -(-size // RANGE_BYTES)))
    bounds = range_bounds(keyed, ranges) if ranges > 1 else []
    sent = spark.sparkContext.broadcast(tuple(zip(*bounds)) or ((), (), ()))
    id_type = keyed.schema["page_id"].dataType

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lows, highs = sent.value
        for part in parts:
            rows, taken = [], []
            for i, (*key, markup) in enumerate(zip(*(part.column(c).to_pylist() for c in (*KEY, "html")))):
                key = tuple(key)
                own = max(bisect_right(firsts, key) - 1, 0)
                # The ranges whose overlap reaches the page: the first not ended to the last begun.
                among = range(min(bisect_left(highs, key), own), max(bisect_right(lows, key) - 1, own) + 1) if firsts else (0,)
                lines = lines_of(markup or "")
                page = page_of(lines)
                text = "\n".join(t for r, t in lines if r != OUT)
                for r in among:
                    taken.append(i)
                    rows.append((r, r == own, page.hashes, page.regions, page.sizes, text if r == own else ""))
            kinds = [pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.string()]
            cols = list(zip(*rows)) if rows else [()] * len(kinds)
            keys = part.select([*KEY, "page_id", "url"]).take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*keys.columns, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[f.name for f in parsed.fields])

    parsed = T.StructType([
        *[T.StructField(c, T.StringType()) for c in KEY[:-1]], T.StructField("mark", T.LongType()), T.StructField("page_id", id_type), T.StructField("url", T.StringType()),
        T.StructField("range", T.IntegerType()), T.StructField("own", T.BooleanType()), T.StructField("hashes", T.ArrayType(T.LongType())),
        T.StructField("regions", T.BinaryType()), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("kept", T.StringType()),
    ])
    ordered = keyed.mapInArrow(parse, parsed).repartitionById(max(1, len(bounds)), "range").sortWithinPartitions("range", *KEY)
    out_fields = pa.schema([("page_id", to_arrow_type(id_type)), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def difference(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A sliding view of REACH pages on each side of the one that is answered."""
        view: list[tuple[Page, dict]] = []
        at, now = 0, None  # the next page of the view to be answered, and its range

        def answer(i: int) -> dict | None:
            page, row = view[i]
            if not row["own"]:
                return None
            left = set(kept_lines(page, [p for p, _ in view[max(0, i - REACH) : i][::-1]], [p for p, _ in view[i + 1 : i + 1 + REACH]]))
            kept = iter(row["kept"].split("\n"))
            lines = ((i, next(kept)) for i, r in enumerate(page.regions) if r != OUT)
            text = "\n\n".join(t for i, t in lines if i in left)
            return {"page_id": row["page_id"], "url": row["url"], "text": text, "n_chars": len(text)}

        def batch(rows: list[dict | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([r for r in rows if r], schema=out_fields)

        for part in parts:
            out = []
            for row in part.to_pylist():
                if row["range"] != now:
                    out += [answer(i) for i in range(at, len(view))]
                    view, at, now = [], 0, row["range"]
                view.append((Page(row["host"], row.pop("hashes"), row.pop("regions"), row.pop("sizes")), row))
                if len(view) - at > REACH:
                    out.append(answer(at))
                    at += 1
                    if at > REACH:
                        view.pop(0)
                        at -= 1
            yield batch(out)
        yield batch([answer(i) for i in range(at, len(view))])

    out = T.StructType([T.StructField("page_id", id_type), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return ordered.mapInArrow(difference, out)
