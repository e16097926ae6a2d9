"""Main text of web pages: differencing against the page of the nearest URL, then page structure.

A page is read into blocks of text with their place in the page; scripts and other hidden elements hold none. Pages are
paired with the nearest URL of other paths of their host, the pair's blocks are aligned by longest common subsequence, and
what they share goes as a template: but not inside an element that marks the article, where a shared block is a
quotation or a copied article. A page that has nothing but what a neighbour has is its copy, and takes no evidence from it.
Of what is left, menus, headers, footers, sidebars, notices, adverts, forms and reader comments go by their elements, unless
such an element holds the page itself: no neighbour may share them. Then the parts marked as the page's own stand for
the page if they hold most of it; a teaser does not.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read

#: Elements whose content is no text of the page.
HIDDEN = frozenset("head script style template noscript iframe object svg math canvas audio video select textarea button datalist option".split())
#: Elements whose content is read as raw text up to their end tag.
RAW = frozenset("script style textarea title noscript iframe xmp".split())
#: Elements around the page's own content.
AROUND = frozenset("nav footer aside form dialog menu".split())
#: Elements that are a block of text, or end one.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr "
    "masthead menu menubar nav navbar navigation newsletter notice pagination pager paywall popup promo promoted related replies reply "
    "share sharing sidebar signup social sponsor sponsored subscribe toolbar widget complementary contentinfo".split()
)
#: Words that name the form of an element, not its topic: ad-slot is a mark alone, share-price is not.
SHAPES = frozenset("area bar block bottom box button buttons container content group inner item items left link links list outer panel posts right section slot top unit wrap wrapper".split())
#: Words beside a mark that make it a note on the page's layout or the article's topic: has-sidebar, comments-open, category-social.
NOTES = frozenset("no has with without hide category tag open closed".split())
#: Shares of a page's text past which an element is its frame, whatever it is marked as: by a mark among other words, by a mark alone.
FRAME = {1: 0.5, 2: 0.9}
#: Elements that mark the page's own part, by rank: class words count for less in an article than in a main part.
ARTICLE = {"main": 1, "article": 2}
#: Share of a page's own text that articles, or a main part, must pass to stand for it; else they are teasers.
MOST = 0.5

_TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
_MARK = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z][a-z]*")
_SPACE = re.compile(r"\s+")


class Block:
    """A block of text: its words with single spaces, the highest rank of the elements around it that mark an article, and whether a marked element holds it."""

    __slots__ = ("inside", "marked", "text")

    def __init__(self, text: str, inside: int, marked: bool = False):
        self.text, self.inside, self.marked = text, inside, marked


@lru_cache(4096)
def _marked(name: str, attributes: str) -> int:
    """How surely an element's name, class, id, role or hiding says that it is not part of the article.

    0 not at all, 1 by a mark among other words, or as a form, 2 by a mark alone, 3 beyond doubt, 4 if it holds no text.
    """
    if name in HIDDEN:
        return 4
    if name in AROUND and name != "form":
        return 3
    level = int(name == "form")
    if not attributes or name in ("html", "body", "main"):
        return level
    for key, value in _MARK.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return 3
        if key in ("class", "id", "role"):
            for token in value.split():
                words = {w.lower() for w in _WORD.findall(token)}
                if words & MARKS and not words & NOTES:
                    level = max(level, 2 if words <= MARKS | SHAPES else 1)
    return level


class Region:
    """A marked element: how surely it is marked, its depth, the marked element around it, what it holds."""

    __slots__ = ("article", "depth", "level", "own", "parent", "sure", "text")

    def __init__(self, level: int, depth: int, parent: Region | None):
        self.level, self.depth, self.parent = level, depth, parent
        self.article, self.own, self.text = False, 0, 0
        self.sure = level == 3 or (parent is not None and parent.sure)


def _dropped(parts: list[tuple[str, int, Region | None, bool]], regions: list[Region]) -> set[Region]:
    """The marked elements that go: not those that hold an article or most of the page's text.

    One that is marked by nothing else must hold most of what articles and main parts hold, as sidebars hold teasers.
    """
    whole = most = 0
    for raw, rank, region, _ in parts:
        size = 0 if region is not None and region.sure else len(raw.strip())
        own = size if rank else 0
        whole, most = whole + size, most + own
        if region is not None:
            region.text, region.own = region.text + size, region.own + own
    for r in reversed(regions):
        if r.parent is not None:
            r.parent.text, r.parent.own, r.parent.article = r.parent.text + r.text, r.parent.own + r.own, r.parent.article or r.article
    gone: set[Region] = set()
    for r in regions:
        if r.sure or r.parent in gone or not (r.text > FRAME[r.level] * whole or (r.article and (r.level == 1 or r.own > MOST * most))):
            gone.add(r)
    return gone


def blocks(page: str) -> list[Block]:
    """The blocks of a page in page order, marked if they are in marked elements that do not hold the page itself.

    Inside an article a class must be a mark alone to count. Tags may be unclosed: an end tag closes all elements down to its own; one without a start is skipped.
    A header counts as the page's unless it stands in an article. A title or a comment never is text.
    """
    parts: list[tuple[str, int, Region | None, bool]] = []  # text, rank, marked element around it, whether it goes on from the part before
    open_names: list[str] = []
    opened: Counter[str] = Counter()
    open_blocks: list[int] = []  # depths of the open elements that are blocks
    regions: list[Region] = []
    region: Region | None = None
    skip_at: int | None = None  # depth of the element that is left out
    articles: list[int] = []  # ranks of the open elements that mark one
    pieces: list[str] = []
    at, size, goes_on = 0, len(page), False

    def flush(inline: bool = False) -> None:
        nonlocal goes_on
        if pieces:
            parts.append(("".join(pieces), max(articles, default=0), region, goes_on))
            pieces.clear()
            goes_on = inline
        elif not inline:
            goes_on = False

    def close(depth: int) -> None:
        nonlocal skip_at, region
        if region is not None and region.depth >= depth:
            flush(open_names[region.depth] not in BLOCKS)
            while region is not None and region.depth >= depth:
                region = region.parent
        while len(open_names) > depth:
            name = open_names.pop()
            opened[name] -= 1
            if name in ARTICLE:
                articles.pop()
        while open_blocks and open_blocks[-1] >= depth:
            open_blocks.pop()
        if skip_at is not None and depth <= skip_at:
            skip_at = None

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at and skip_at is None:
            pieces.append(page[at:lt])
        if lt == size:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            following = page[lt + 1 : lt + 2]
            if following.isalpha() or following == "/":  # a broken tag ends at the next sign of one
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
                if skip_at is None:
                    pieces.append(" ")
            else:
                if skip_at is None:
                    pieces.append("<")
                at = lt + 1
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if name in BLOCKS:
                flush()
            if opened[name]:
                depth = len(open_names) - 1
                while open_names[depth] != name:
                    depth -= 1
                close(depth)
            continue
        if name in BLOCKS:
            flush()
            if name != "br":  # a paragraph or list item ends where the next block begins
                last = open_blocks[-1] if open_blocks else None
                if last is not None and (open_names[last] == "p" or open_names[last] == name == "li"):
                    close(last)
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            continue
        level = 0 if skip_at is not None else 3 if name == "header" and not articles else _marked(name, m[3])
        if level == 1 and 2 in articles and name != "form":
            level = 0
        if level == 4:
            flush()
            skip_at = len(open_names)
        elif skip_at is None and level < 3 and name in ARTICLE and 2 not in articles:  # its words are its topics and layout
            if level == 0 and region is not None:
                region.article = True
        elif level:
            flush(name not in BLOCKS)
            region = Region(level, len(open_names), region)
            regions.append(region)
        if name in BLOCKS:
            open_blocks.append(len(open_names))
        open_names.append(name)
        opened[name] += 1
        if name in ARTICLE:
            articles.append(ARTICLE[name])
        if name in RAW:
            end = _raw_end(page, name, at)
            if skip_at is None and name != "title":
                pieces.append(page[at:end])
            at = end
    flush()
    gone = _dropped(parts, regions)
    texts: list[tuple[str, int, bool]] = []
    for i, (raw, rank, around, after) in enumerate(parts):
        marked = around in gone
        if after and texts and marked == texts[-1][2]:
            texts[-1] = (texts[-1][0] + raw, max(rank, texts[-1][1]), marked)
        else:
            texts.append((raw, 0 if marked else rank, marked))
    found = ((_SPACE.sub(" ", entities.unescape(raw)).strip(), rank, marked) for raw, rank, marked in texts)
    return [Block(text, rank, marked) for text, rank, marked in found if text]


_ENDS: dict[str, re.Pattern] = {}


def _raw_end(page: str, name: str, at: int) -> int:
    pattern = _ENDS.setdefault(name, re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE))
    m = pattern.search(page, at)
    return m.start() if m else len(page)


def shared_blocks(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """Positions of a longest common subsequence of two lists of blocks, in each."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    own, other = set(range(head)) | set(range(len(a) - tail, len(a))), set(range(head)) | set(range(len(b) - tail, len(b)))
    # only what occurs in both can align, so rows without partners are left out of the table
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    x = [i for i in range(head, len(a) - tail) if a[i] in both]
    y = [j for j in range(head, len(b) - tail) if b[j] in both]
    if x and y:
        for i, j in _aligned([a[i] for i in x], [b[j] for j in y]):
            own.add(x[i])
            other.add(y[j])
    return own, other


#: Bits of the table of an alignment that are held at once.
TABLE = 1 << 28


def _row(a: list[str], b: list[str], rows: list[bytes] | None = None) -> int:
    """The last row of the table of common subsequences as the bits of one number: 0 where the length grows by one."""
    masks: dict[str, int] = {}
    for j, t in enumerate(b):
        masks[t] = masks.get(t, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, size = full, len(b) // 8 + 1
    for s in a:
        both = row & masks.get(s, 0)
        row = ((row + both) | (row - both)) & full
        if rows is not None:
            rows.append(row.to_bytes(size, "little"))
    return row


def _aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence. A table past TABLE is halved, so that memory is linear."""
    if not a or not b:
        return []
    if len(a) == 1:
        return [(0, b.index(a[0]))] if a[0] in b else []
    if len(a) * len(b) <= TABLE:
        rows: list[bytes] = []
        _row(a, b, rows)
        pairs, i, j = [], len(a), len(b)
        while i and j:
            at, bit = (j - 1) >> 3, 1 << ((j - 1) & 7)
            if rows[i - 1][at] & bit:
                j -= 1
                continue
            i -= 1
            if not i or rows[i - 1][at] & bit:
                j -= 1
                pairs.append((i, j))
        return pairs[::-1]
    middle = len(a) // 2

    def lengths(p: list[str], q: list[str]) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(_row(p, q).to_bytes(len(q) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(q)]
        return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])

    cut = int(np.argmax(lengths(a[:middle], b) + lengths(a[middle:][::-1], b[::-1])[::-1]))
    return _aligned(a[:middle], b[:cut]) + [(i + middle, j + cut) for i, j in _aligned(a[middle:], b[cut:])]


def differenced(own: list[Block], near: list[list[Block]]) -> tuple[str, int, int]:
    """The text of a page, its blocks that went because a page near it has them, too, and those that went by their elements alone.

    The page's marked parts stand for it if they hold most of what is left.
    """
    texts, shared_with_any = [b.text for b in own], set()
    for other in near:
        shared, _ = shared_blocks(texts, [b.text for b in other])
        if any(not b.marked and i not in shared for i, b in enumerate(own)):  # else the page is a copy
            shared_with_any |= {i for i in shared if not own[i].inside}
    kept = [b for i, b in enumerate(own) if not b.marked and i not in shared_with_any]
    part = [b.text for b in kept if b.inside]
    alone = sum(map(len, part)) > MOST * sum(len(b.text) for b in kept)
    gone_by_marks = sum(b.marked and i not in shared_with_any for i, b in enumerate(own))
    return " ".join(part if alone else [b.text for b in kept]), len(shared_with_any), gone_by_marks


def main_text(own: list[Block], near: list[list[Block]]) -> str:
    """The text of a page by differenced()."""
    return differenced(own, near)[0]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, lower-case host, no query, fragment, trailing slash or page ending."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"[?#].*$", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/]*", 0))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/]*(/.*)?$", 1), r"(/|\.html?)+$", "")
    return host, path


def _ordered(row: tuple) -> tuple:
    """A (host, path, key) as Spark orders it, nulls first."""
    return row[0], row[1], row[2] is not None, row[2]


def _beside(a: tuple | None, b: tuple) -> bool:
    """Whether two (host, path, key) are of one host and of different paths."""
    return a is not None and a[0] == b[0] and a[1] != b[1]


class Ranges:
    """Ranges of the order (host, path, key), and the pages of other ranges that their first and last paths are paired with."""

    def __init__(self, ends: list[tuple[tuple, tuple, tuple | None, tuple | None]]):
        """ends: first page, last page, first page of the second path, last page of the last path but one of each range, in order."""
        self.firsts = [_ordered(e[0]) for e in ends]
        self.foreign: dict[tuple, list[int]] = {}
        before: list[tuple | None] = []
        for r, (first, _, _, _) in enumerate(ends):
            found = None
            if r:
                _, last, _, inner = ends[r - 1]
                found = last if last[:2] != first[:2] else inner or before[r - 1]
            before.append(found)
            self._send(found, first, r)
        after: tuple | None = None
        for r in range(len(ends) - 1, -1, -1):
            last = ends[r][1]
            if r + 1 < len(ends):
                first, _, inner, _ = ends[r + 1]
                after = first if first[:2] != last[:2] else inner or after
            self._send(after, last, r)

    def _send(self, page: tuple | None, to: tuple, r: int) -> None:
        if _beside(page, to):
            self.foreign.setdefault(_ordered(page), []).append(r)

    def of(self, row: tuple) -> list[tuple[int, bool]]:
        """(range, whether the page is the range's own): its range, and those that it is a neighbour of."""
        place = _ordered(row)
        own = max(0, bisect_right(self.firsts, place) - 1)
        return [(own, True), *((r, False) for r in self.foreign.get(place, ()))]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a range of pages in order: its first and last page, and those of the paths next to theirs."""
    first = last = second = inner = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if first is None:
                first = row
            elif row[:2] != last[:2]:
                inner, second = last, second or row
            last = row
    if first is not None:
        kinds = [batch.schema.field(i).type for i in range(3)]
        columns = [pa.array([page[i] if page else None], kinds[i]) for page in (first, last, second, inner) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([second is not None])], [f"{c}{n}" for n in range(4) for c in "hpk"] + ["more"])


#: Bytes of pages in a range, and ranges at most: each one's ends go through the driver.
RANGE_BYTES, RANGES = 8 << 20, 1 << 16
#: Pages of a range, about, that are sampled for the cuts; they go through the driver, too.
SAMPLED = 20


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row a page: key, url, text, n_chars (code points), n_shared and n_marked (blocks that went by differencing, and by marks alone).

    A page is paired with the last page of the path before its own and the first page of the path after it, in the order of
    (host, path, key), if they are of its host: the nearest URLs of other paths, however many pages share its path. The order
    is cut into ranges of about RANGE_BYTES, so that a large host or path is shared out; pages that pair with another range
    also go there, so the cuts change no pair. Pages are read once into blocks, and only
    blocks are shuffled. A null page is empty and has no text; null URLs are a host of their own. Pages without
    neighbours keep all blocks that their structure leaves. Repeated rows stay; other columns are not read; an empty table
    gives no rows. A task holds the distinct contents of one path's pages in its range.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url))
    place = pages.select(host.alias("host"), path.alias("path"), F.col(key).alias("k"))
    size = pages.agg(F.sum(F.octet_length(html))).first()[0] or 0
    count = min(RANGES, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // 2))
    kind = pages.schema[key].dataType.simpleString()
    ends = place.repartitionByRange(count, "host", "path", "k").sortWithinPartitions("host", "path", "k")
    ends = ends.mapInArrow(_ends, ", ".join(f"h{n} string, p{n} string, k{n} {kind}" for n in range(4)) + ", more boolean")
    setting = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(SAMPLED))
    try:
        ends = ends.collect()
    finally:
        spark.conf.set(setting, before)
    ends = [tuple(tuple(e[3 * n : 3 * n + 3]) if n < 2 or e["more"] else None for n in range(4)) for e in ends]
    shared = spark.sparkContext.broadcast(Ranges(sorted(ends, key=lambda e: _ordered(e[0]))))

    def place_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, taken, columns = batch.slice(i, 256), [], [[], [], [], [], []]
                for j, (k, h, p, page) in enumerate(zip(*(part.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True)):
                    found = blocks(page)
                    for r, own in ranges.of((h, p, k)):
                        taken.append(j)
                        for column, value in zip(columns, (r, own, [b.text for b in found], [b.inside for b in found], [b.marked for b in found]), strict=True):
                            column.append(value)
                arrays = [part.column(c).take(pa.array(taken, pa.int64())) for c in range(4)]
                arrays += [pa.array(column, kind) for column, kind in zip(columns, (pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.bool_())), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["k", "u", "host", "path", "r", "own", "texts", "inside", "marked"])

    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), host.alias("host"), path.alias("path"), F.coalesce(F.col(html), F.lit("")).alias("page"))
    placed = rows.mapInArrow(place_blocks, f"k {kind}, u string, host string, path string, r int, own boolean, texts array<string>, inside array<int>, marked array<boolean>")
    placed = placed.repartition(tasks, "r").sortWithinPartitions("r", "host", "path", "k", "u")
    found = placed.mapInArrow(_differences, f"k {kind}, u string, text string, n_chars long, n_shared long, n_marked long")
    return found.select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_chars", "n_shared", "n_marked")


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the pages of each range, which come in order: the pages of a path are done when the next path is there."""
    before: list[Block] | None = None  # the blocks of the last page of the path before
    beside: tuple = ()  # its range and host
    place: tuple = ()  # range, host and path of this group
    group: dict[tuple, list[tuple]] = {}  # the pages of this path by their content
    last: list[Block] = []

    def done(after: list[Block] | None, where: tuple) -> list[tuple]:
        near = [other for other, at in ((before, beside), (after, where)) if other is not None and at == place[:2]]
        out = []
        for content, rows in group.items():
            text, shared, marked = differenced([Block(*b) for b in content], near)
            out += [(*row, text, len(text), shared, marked) for row in rows]
        return out

    schema = None
    for batch in batches:
        schema, out = batch.schema, []
        for k, u, host, path, r, own, texts, inside, marked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            content = tuple(zip(texts, inside, marked, strict=True))
            if place != (r, host, path):
                now = [Block(*b) for b in content]
                if place:
                    out += done(now, (r, host))
                    before, beside = last, place[:2]
                place, group = (r, host, path), {}
            if own:
                group.setdefault(content, []).append((k, u))
            last = [Block(*b) for b in content]
        yield _texts(out, schema)
    if schema is not None:
        yield _texts(done(None, ()) if place else [], schema)


def _texts(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    kinds = (schema.field(0).type, schema.field(1).type, pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["k", "u", "text", "n_chars", "n_shared", "n_marked"])


def op5_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
