"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by host and URL path.  A page's partner is the one beside it in that order, of the same host, whose path
shares more leading segments with its own.  The text lines of both (a line is the text of one block) are aligned by a
longest common subsequence.  Shared lines belong to the site and are deleted, and so are the page's own lines in a block
that opens with a shared line (the comments under "Comments", the links under "Related"), unless the block holds half of
what the page has for itself.

Marks settle what differencing leaves open.  Sites need not use one template on neighbouring URLs: in the tables at hand
menus, adverts and footers differ from page to page, and three pairs of neighbours share one line, so that differencing
alone would leave nearly all of them in.
- Where a page marks an article (``article``, or where there is none ``main``), lines outside it go, shared or not, and
  prose in it is kept where a partner shares it, as articles quote one another; shared lines that are mostly links go;
- readers' comments are the page's own, so marks must tell them: an article within an article, or a class or id that is
  the word ``comment`` or ``comments``; no other class or id is looked at;
- scripts, styles, forms and hidden elements are no text; a page's own lines in ``nav``, ``footer``, ``aside``, ``menu``,
  ``search`` or a ``header`` outside the article are none of the article;
- a partner that shares half of a page's prose is a copy of it, and tells nothing: the other neighbour is tried;
- where a host has no other page, or both neighbours are copies, the marked article is all there is to go by; without one,
  all lines but those in the elements above are the text.

Ranges of the order are read as streams: the table is cut at quantiles of (host, path, id), each range's first and last
row go to the neighbouring range too, and one pass in order does the rest.  A host with a third of all pages is cut into
ranges like any other.  Time grows with the length of the page, broken markup or not; aligning takes one operation on a
bit for each pair of lines that occur in both pages, and memory in proportion to them.

Defined results: null html is empty and gives an empty text; a null or odd URL is a host of its own, ''; rows that repeat
an id or URL are neighbours, in the order of their html; an empty table gives an empty result; other columns aren't
carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_MARKED = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
#: Elements by how they are read.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SWALLOW = frozenset("script style title textarea".split())
_RAW = _SWALLOW | frozenset("noscript template iframe svg math object select xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_NO_TEXT = frozenset("form dialog button fieldset head".split())
_ASIDE = frozenset("nav footer aside menu search".split())
_COMMENTS = frozenset("comment comments".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search".split())
#: A partner that shares this part of a page's prose is a copy; shared lines with this part in links are no prose.
COPY, LINKS = 0.5, 0.6
#: Rows of bits that an alignment keeps at a time, in bytes; beyond it is halved.
ALIGNED = 1 << 26
_ARTICLE, _MAIN = 2, 1


@dataclass(slots=True)
class Line:
    text: str
    mark: int  # in a marked article, in a marked main part, or 0
    aside: bool  # in an element that is none of the article
    links: int  # characters in links
    block: int  # the block that it is in, by the order in which they open


@dataclass(slots=True)
class Page:
    lines: list[Line]
    parents: list[int]  # of each block the one around it


class _Scan:
    """Tags of a page in order, in time linear in its length."""

    def __init__(self, html: str):
        self.html, self.quotes = html, {q: html.rfind(q) for q in "\"'"}
        self.end = html.rfind(">")
        self.open: set[str] = set()  # raw elements that are not closed any more

    def tag_end(self, at: int) -> int:
        """The place of the > that ends the tag, quoted ones passed over."""
        spot = at
        while found := _STOP.search(self.html, spot):
            if found[0] == ">":
                return found.start()
            if self.quotes[found[0]] <= found.start():
                break
            spot = self.html.index(found[0], found.end()) + 1
        # a quote that is never closed: from here on quotes don't count
        self.quotes = dict.fromkeys(self.quotes, -1)
        return self.html.index(">", at)

    def after_raw(self, name: str, at: int) -> int:
        """Where a raw element that opened before ends."""
        if name not in self.open:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(self.html, at)
            if close:
                return close.end()
            self.open.add(name)
        return len(self.html) if name in _SWALLOW else at

    def __iter__(self) -> Iterator[tuple[str, str, bool, str]]:
        """(text before, name, closing, attributes); the last has no name."""
        html, at, start = self.html, 0, 0
        while 0 <= (spot := html.find("<", at)) <= self.end:
            name = _NAME.match(html, spot + 1)
            closing = not name and html.startswith("</", spot)
            if closing:
                name = _NAME.match(html, spot + 2)
            if not name:
                if html.startswith("<!--", spot):
                    stop = html.find("-->", spot + 4)
                    stop = len(html) if stop < 0 else stop + 3
                elif closing or html.startswith(("<!", "<?"), spot):
                    stop = html.index(">", spot) + 1
                else:
                    at = spot + 1
                    continue
                yield html[start:spot], "", False, ""
                at = start = stop
                continue
            stop = self.tag_end(name.end())
            kind = name[0].lower()
            yield html[start:spot], kind, closing, html[name.end() : stop]
            at = start = stop + 1 if closing or kind not in _RAW else self.after_raw(kind, stop + 1)
        yield html[start:], "", False, ""


def lines(html: str | None) -> Page:
    """The page's lines in order, with what markup says of each."""
    out = Page([], [-1])
    if not html:
        return out
    held: list[str] = []
    linked = 0
    # open elements: (name, block, no text, mark, aside, in a link); inline ones that are open in each open block, by name
    stack: list[tuple[str, int, bool, int, bool, bool]] = [("", 0, False, 0, False, False)]
    blocks, inline = [0], [{}]
    names: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                _, block, _, mark, aside, _ = stack[blocks[-1]]
                out.lines.append(Line(text, mark, aside, linked, block))
            held.clear()
        linked = 0

    def close(to: int) -> None:
        """Close the open elements from the to-th on."""
        while len(stack) > to:
            if blocks[-1] == len(stack) - 1:
                names[stack[-1][0]] -= 1
                blocks.pop()
                inline.pop()
            else:
                inline[-1][stack[-1][0]] -= 1
            stack.pop()

    for text, name, closing, attributes in _Scan(html):
        if text and not stack[-1][2]:
            held.append(text)
            if stack[-1][5]:
                linked += len(text)
        if not name:
            continue
        if closing:
            if name in _BLOCK:
                if names.get(name):
                    flush()
                    at = len(blocks) - 1
                    while stack[blocks[at]][0] != name:
                        at -= 1
                    close(blocks[at])
                elif name == "p":
                    flush()
            elif inline[-1].get(name):
                at = len(stack) - 1
                while stack[at][0] != name:
                    at -= 1
                close(at)
            continue
        if name in _RAW:
            continue
        if name in _BLOCK:
            flush()
            # a block ends an open paragraph, and an item the item before
            top = stack[blocks[-1]][0]
            if top == "p" or (top == name and name in ("li", "dd", "dt", "tr", "td", "th", "option")):
                close(blocks[-1])
        if name in _VOID:
            if name in ("br", "hr", "img", "wbr") and not stack[-1][2]:
                held.append("" if name == "wbr" else " ")
            continue
        if attributes.rstrip().endswith("/") and name not in _BLOCK:
            continue
        _, block, no_text, mark, aside, link = stack[-1]
        if not no_text:
            said = {key.lower(): (a or b or c).lower() for key, a, b, c in _MARKED.findall(attributes)} if attributes else {}
            role = said.get("role", "")
            no_text = name in _NO_TEXT or "hidden" in said or said.get("aria-hidden") == "true"
            aside |= not _COMMENTS.isdisjoint((said.get("class", "") + " " + said.get("id", "")).split())
            if name == "article" or role == "article" or said.get("itemprop") == "articlebody":
                aside |= name == "article" and mark == _ARTICLE  # a comment
                mark = _ARTICLE
            elif (name == "main" or role == "main") and not mark:
                mark = _MAIN
            else:
                aside |= name in _ASIDE or role in _ASIDE_ROLES or (name == "header" and not mark)
        if name in _BLOCK:
            out.parents.append(block)
            block = len(out.parents) - 1
            blocks.append(len(stack))
            inline.append({})
            names[name] = names.get(name, 0) + 1
        else:
            inline[-1][name] = inline[-1].get(name, 0) + 1
        stack.append((name, block, no_text, mark, aside, link or name == "a"))
    flush()
    return out


class _Matches:
    """For each line the bits of its places in b."""

    def __init__(self, b: list[int]):
        self.size, self.spots, self.kept = len(b), {}, {}
        for j, x in enumerate(b):
            self.spots.setdefault(x, []).append(j)

    def get(self, x: int) -> int:
        bits = self.kept.get(x)
        if bits is None:
            data = bytearray(self.size // 8 + 1)
            for j in self.spots.get(x, ()):
                data[j >> 3] |= 1 << (j & 7)
            bits = int.from_bytes(data, "little")
            if len(self.kept) * len(data) < ALIGNED:
                self.kept[x] = bits
        return bits


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each line of a the bits of b's lines: the zeros below a place count the longest common subsequence up to it."""
    row = full = (1 << len(b)) - 1
    matches = _Matches(b)
    for x in a:
        both = row & matches.get(x)
        row = ((row + both) | (row - both)) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The longest common subsequence of a with each beginning of b."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _aligned(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence with b."""
    low, high = 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    ends = [*range(low), *range(len(a) - high, len(a))]
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    there, here = set(b), set(a)
    spots, b = [i for i, x in enumerate(a) if x in there], [x for x in b if x in here]
    a = [a[i] for i in spots]
    if not a or not b:
        return ends
    if len(a) * len(b) <= 8 * ALIGNED:
        rows = [row.to_bytes(len(b) // 8 + 1, "little") for row in _rows(a, b)]
        i, j = len(a) - 1, len(b) - 1
        while i >= 0 and j >= 0:
            if rows[i][j >> 3] >> (j & 7) & 1:
                j -= 1
            elif i and not rows[i - 1][j >> 3] >> (j & 7) & 1:
                i -= 1
            else:
                ends.append(low + spots[i])
                i, j = i - 1, j - 1
        return ends
    half = len(a) // 2
    cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[:half - 1 : -1], b[::-1])[::-1]))
    found = _aligned(a[:half], b[:cut]) + [half + i for i in _aligned(a[half:], b[cut:])]
    return ends + [low + spots[i] for i in found]


def shared(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence with b."""
    number: dict[str, int] = {}
    return set(_aligned(*([number.setdefault(x, len(number)) for x in lines] for lines in (a, b))))


def _inside(own: Page) -> list[bool]:
    """Which lines lie in the marked article, if the page marks one."""
    level = max((x.mark for x in own.lines if not x.aside), default=0)
    return [bool(level) and x.mark >= level and not x.aside for x in own.lines]


def marked_text(own: Page) -> str:
    """The text by marks alone: for pages that have nothing to be told apart from."""
    inside = _inside(own)
    some = any(inside)
    return "\n\n".join(x.text for x, i in zip(own.lines, inside, strict=True) if (i if some else not x.aside))


def own_lines(own: Page, found: set[int]) -> list[int]:
    """The lines that stay when those in found are shared."""
    inside, n = _inside(own), len(own.parents)
    if any(inside):
        return [i for i, x in enumerate(own.lines) if inside[i] and (i not in found or x.links < LINKS * len(x.text))]
    stays = [i not in found and not x.aside for i, x in enumerate(own.lines)]
    # blocks that open with a shared line: their own lines go too
    chars, opens = [0] * n, [-1] * n
    for i, x in enumerate(own.lines):
        chars[x.block] += len(x.text) * stays[i]
        if opens[x.block] < 0:
            opens[x.block] = i
    for e in range(n - 1, 0, -1):
        up = own.parents[e]
        chars[up] += chars[e]
        if opens[e] >= 0 and (opens[up] < 0 or opens[e] < opens[up]):
            opens[up] = opens[e]
    site = [False] * n
    for e in range(1, n):
        site[e] = site[own.parents[e]] or (opens[e] in found and 2 * chars[e] < chars[0])
    return [i for i, x in enumerate(own.lines) if stays[i] and not site[x.block]]


def main_text(own: Page, partners: list[Page]) -> str:
    """own without what it shares with the first of partners that is no copy of it; by marks alone if there is none."""
    texts, inside = [x.text for x in own.lines], _inside(own)
    some = any(inside)
    prose = [len(x.text) * (i if some else not x.aside) for x, i in zip(own.lines, inside, strict=True)]
    for partner in partners:
        found = shared(texts, [x.text for x in partner.lines])
        if not sum(prose) or sum(prose[i] for i in found) < COPY * sum(prose):
            return "\n\n".join(texts[i] for i in own_lines(own, found))
    return marked_text(own)


def _likeness(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


SCHEMA = "page_id bigint, url string, text string, n_chars bigint"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _order(url: Column, page_id: Column) -> tuple[Column, Column]:
    """(host, key): the key sorts by host, path and id."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(path, r"(/|\.html?|/index\.html?)$", "")
    sep = F.lit("\x01")
    return host, F.concat(host, sep, path, sep, F.lpad(F.coalesce(page_id.cast("string"), F.lit("")), 20, "0"))


def extract(df: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of df(page_id, url, html)."""
    spark = df.sparkSession
    small_batches(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    host, key = _order(F.col("url"), F.col("page_id"))
    rows = df.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host.alias("host"), key.alias("key"))
    ranges = rows.select("key").repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("a"), F.max("key").alias("z")).collect()
    ranges = sorted((r.a, r.z) for r in ranges)  # one for each partition
    if not ranges:
        return spark.createDataFrame([], SCHEMA)
    firsts = np.asarray([a for a, _ in ranges], object)

    @F.arrow_udf("array<struct<part: int, role: int>>")
    def goes(column: pa.Array) -> pa.Array:
        out = []
        for k in column.to_pylist():
            # strings sort by code point, here as in Spark
            own = max(0, int(np.searchsorted(firsts, k, "right")) - 1)
            to = [{"part": own, "role": 1}]
            if k == ranges[own][0] and own:
                to.append({"part": own - 1, "role": 2})
            if k == ranges[own][1] and own + 1 < len(ranges):
                to.append({"part": own + 1, "role": 0})
            out.append(to)
        return pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("role", pa.int32())])))

    sent = rows.withColumn("to", F.explode(goes(F.col("key")))).select("page_id", "url", "html", "host", "key", "to.part", "to.role")
    dealt = sent.repartitionById(len(ranges), F.col("part")).sortWithinPartitions("part", "role", "key", "html")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(row, the row before, the row after) of each row of role 1; rows are (page_id, url, host, key, lines, role)."""
        before = row = None
        for batch in batches:
            small = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "host", "key", "role")), batch.column("html"), strict=True)
            for page_id, url, host, key, role, html in small:
                after = (page_id, url, host, key.split("\x01")[1].split("/"), lines(html.as_py()), role)
                if row is not None and row[5] == 1:
                    yield row, before, after
                before, row = row, after
        if row is not None and row[5] == 1:
            yield row, before, None

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for row, before, after in stream(batches):
            beside = [x for x in (before, after) if x is not None and x[2] == row[2]]
            beside.sort(key=lambda x: -_likeness(x[3], row[3]))
            text = main_text(row[4], [x[4] for x in beside])
            out.append((row[0], row[1], text, len(text)))
            size += len(text)
            if size > 1 << 20 or len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return dealt.mapInArrow(pages, SCHEMA)
