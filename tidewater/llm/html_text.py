"""Main text of web pages by nearest-URL page differencing.

A page is cut into lines (its blocks) with what its structure says of each: part
of the article, part of something that is no article (menus, adverts, comments …),
doubtful (in the article, but below a name such as banner or widget that says little),
or open. Pages of a host are ordered by URL path and each is paired with its nearest
neighbours that are no copies of it; open and doubtful lines that the longest common
subsequence of the two pages shares are the site's, not the page's, and are deleted,
whatever share of the page they are. Other lines of a marked article stay: pages
that carry the same article, or quote the same passage, would else lose it.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Pages of a block, a stretch of neighbouring pages, and most block boundaries that the driver holds (blocks grow beyond).
BLOCK_PAGES, MAX_BLOCKS = 500, 50_000
#: Blocks of a task, on average.
TASK_BLOCKS = 4

MAIN, OPEN, DOUBTFUL = 1, 2, 3

#: HTML elements whose content is never article text.
_SKIPPED = frozenset("script style noscript template svg math canvas iframe object embed audio video head title select option datalist button form input textarea nav footer aside menu dialog map".split())
_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr script style noscript template svg button input select".split())
#: Words in class, id and role that name what is not the article.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices "
    "notification popup newsletter subscribe subscription nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside "
    "footer share sharing related recommended recommendations comment comments commentlist disqus pagination teaser teasers "
    "disclaimer copyright tagcloud complementary contentinfo".split()
)
#: Words that often do so, but name articles and their parts as well; what other pages of the host show decides.
_DOUBTED = frozenset("banner banners alert modal overlay signup login side foot masthead topbar toolbar social reply replies respond discussion widget widgets pager skip search tags".split())
#: Words that may stand beside them in a name without changing what it names; 'with-sidebar' or 'share-price' names something else.
_BESIDE = frozenset(
    "site page main post entry article blog user reader global primary secondary mobile desktop top bottom left right upper lower inner outer fixed sticky floating "
    "container wrapper wrap box bar area section block group list item items link links button buttons icon icons form field panel column col row content body text title "
    "header head heading message msg unit slot space image img thread node author count number form js id the inline footer sub mini small large big wide narrow vertical horizontal new old alt ext std".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</?[a-zA-Z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^'\">])*>|</?[a-zA-Z][^<>]*>", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_CLOSERS = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}


def _names_other(token: str, main: bool) -> int:
    """2 if a class, id or role names something that is not the article, 1 if it may, else 0.

    All its words must name such a thing or may stand beside one that does; numbers and
    one or two letters (sizes, versions) say nothing.
    """
    parts = [x.lower() for x in _PART.findall(token) if not x.isdigit()]
    parts = [x for x in parts if len(x) > 2 or x in _NAMES or x in _DOUBTED]
    named = not _NAMES.isdisjoint(parts) or not main and "header" in parts
    doubted = not _DOUBTED.isdisjoint(parts)
    if token.lower() in _NAMES:
        return 2
    if not (named or doubted) or any(x not in _NAMES and x not in _DOUBTED and x not in _BESIDE for x in parts):
        return 0
    return 2 if named else 1


def _named_off(tag: str, main: bool) -> int:
    """What class, id, role or hiding marks of a tag say: 2 it is not the article, 1 it may be none, 0 nothing. A header in the article is its own."""
    says = 0
    for name, a, b, c in _ATTR.findall(tag):
        raw, name = a or b or c, name.lower()
        value = raw.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return 2
        if name == "style":
            if re.search(r"display\s*:\s*none", value):
                return 2
        else:
            says = max([says, *(_names_other(t, main) for t in raw.split())])
    return says


class _Line:
    """A block that is being read: its pieces, the state and article of its first one, and how much of it is links."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.state, self.article, self.linked, self.size = OPEN, 0, 0, 0

    def add(self, piece: str, state: int, article: int, linked: bool) -> None:
        if not self.pieces:
            self.state, self.article, self.linked, self.size = state, article, 0, 0
        self.pieces.append(piece)
        n = len(piece.strip())
        self.size += n
        self.linked += n if linked else 0


def _without_teasers(lines: list[tuple[int, str, int, bool]]) -> list[tuple[int, str]]:
    """(state, text) of lines (state, text, article, is a link); articles that begin with a link and are short beside the longest one are teasers of other pages."""
    size: dict[int, int] = {}
    opens: dict[int, bool] = {}
    for _, text, article, link in lines:
        if article:
            size[article] = size.get(article, 0) + len(text)
            opens.setdefault(article, link)
    longest = max(size.values(), default=0)
    teasers = {a for a, n in size.items() if opens[a] and 3 * n < longest}
    return [(OPEN if article in teasers else state, text) for state, text, article, _ in lines]


def page_lines(page: str | None) -> list[tuple[int, str]]:
    """(state, text) of each block in page order; character references decoded, white space folded, empty blocks left out."""
    if not page:
        return []
    out: list[tuple[int, str, int, bool]] = []
    line = _Line()
    # open elements: name, is off, is in the article, is off whatever it holds, is doubtful
    stack: list[tuple[str, bool, bool, bool, bool]] = []
    off = main = shut = doubt = False
    article = links = 0  # of the page's articles the one that is open or was last; open links
    at, n = 0, len(page)

    def end_block():
        if line.pieces:
            text = _SPACE.sub(" ", html.unescape("".join(line.pieces))).strip(" ")
            text = " ".join(text.split())
            line.pieces.clear()
            if text:
                out.append((line.state, text, line.article, 0 < line.size <= line.linked))

    def state():
        return DOUBTFUL if main and doubt else MAIN if main else OPEN

    def cut(k: int):
        nonlocal off, main, shut, doubt, links
        links -= sum(x[0] == "a" for x in stack[k:])
        del stack[k:]
        off, main, shut, doubt = stack[-1][1:] if stack else (False, False, False, False)

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and not off:
            line.add(page[at : m.start()], state(), article if main else 0, links > 0)
        at = m.end()
        tag = _TAG.match(m[0])
        if tag is None:
            continue
        closing, name = tag[1], tag[2].lower()
        if name not in _INLINE:
            end_block()
        elif name == "br" and line.pieces:
            line.pieces.append(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    cut(k)
                    break
            continue
        if name in _RAW:
            close = _CLOSERS[name].search(page, at)
            at = close.end() if close else n
            continue
        if name in _VOID or m[0].endswith("/>"):
            continue
        if name == "p" or name == "li":  # an open paragraph or item ends here
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    cut(k)
                    break
                if stack[k][0] not in _INLINE:
                    break
        # a name shuts out what it wraps, but not an article below it; an element's kind does
        now_shut = shut or name in _SKIPPED or name == "header" and not main
        opens = name in ("article", "main") or "main" in m[0] and re.search(r"role\s*=\s*[\"']?main\b", m[0], re.I) is not None
        says = _named_off(m[0], main or opens) if name not in ("html", "body") and len(m[0]) > len(name) + 2 else 0
        now_off, now_doubt = off or says == 2, doubt or says == 1 and not opens
        if opens and not main:
            now_off, now_doubt = says == 2, False
            article += not now_off
        off, main, shut, doubt = now_off or now_shut, main or opens and not now_off, now_shut, now_doubt
        links += name == "a"
        stack.append((name, off, main, shut, doubt))
    if at < n and not off:
        line.add(page[at:], state(), article if main else 0, links > 0)
    end_block()
    return _without_teasers(out)


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (bit-parallel rows, traced back)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = set(range(head)) | set(range(len(a) - tail, len(a)))
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if not x or not y or set(x).isdisjoint(y):
        return found
    where: dict[str, int] = {}
    for j, line in enumerate(y):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(y)) - 1
    row, rows = full, [full]
    for line in x:  # a zero bit is a column where the length grows
        u = row & where.get(line, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    i, j = len(x), len(y)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            found.add(head + i - 1)
            i, j = i - 1, j - 1
    return found


def main_text(lines: list[tuple[int, str]], neighbours: list[list[str]]) -> str:
    """The article's lines, or without an article the open ones; doubtful and open lines that a neighbour shares go."""
    has_main = any(state == MAIN for state, _ in lines)
    own = [k for k, (state, _) in enumerate(lines) if state != MAIN]
    gone: set[int] = set()
    for other in neighbours:
        gone |= {own[k] for k in common_lines([lines[k][1] for k in own], other)}
    return "\n\n".join(text for k, (state, text) in enumerate(lines) if state == MAIN or k not in gone and (state == DOUBTFUL or not has_main))


_HOST = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.S)


def _key(url: str | None, page_id) -> tuple[str, str, str]:
    m = _HOST.match(url or "")
    return (m[1].lower(), m[2], str(page_id)) if m else ("", url or "", str(page_id))


def _host_path(c):
    known = F.regexp_extract(c, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(c, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    has = F.coalesce(F.instr(c, "://") > 0, F.lit(False))
    return F.lower(F.when(has, known).otherwise("")), F.when(has, path).otherwise(F.coalesce(c, F.lit("")))


def _boundaries(pages: DataFrame, blocks: int | None) -> list[tuple[tuple[str, str, str], tuple[str, str, str]]]:
    """(last page of a block, first page of the next) in the order (host, path, id); at most ``MAX_BLOCKS``.

    The keys alone are range-sorted and numbered; pages of one host, however
    many, are cut into blocks like any others.
    """
    host, path = _host_path(F.col("url"))
    keys = pages.select(host.alias("host"), path.alias("path"), F.coalesce(F.col("page_id").cast("string"), F.lit("None")).alias("id"))
    ordered = keys.repartitionByRange("host", "path", "id").sortWithinPartitions("host", "path", "id")
    numbered = materialize(ordered.withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id()}), "order")
    sizes = {r.part: r.n for r in numbered.groupBy("part").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return []
    start, before = {}, 0
    for part in sorted(sizes):
        start[part] = before
        before += sizes[part]
    base = F.element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), F.col("part"))
    # positions within a partition count from 0 in its low bits
    rank = base + F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))
    width = -(-total // min(blocks or -(-total // BLOCK_PAGES), MAX_BLOCKS))
    edge = numbered.withColumn("rank", rank).where((F.col("rank") % width == 0) | (F.col("rank") % width == width - 1))
    rows = sorted((r["rank"], (r.host, r.path, r.id)) for r in edge.collect())
    by = dict(rows)
    return [(by[k - 1], by[k]) for k, _ in rows if k % width == 0 and k]


def extract(pages: DataFrame, *, blocks: int | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A page loses every line outside a marked article, and every doubtful one in it, that the
    nearest page before or after it in its host shares, copies (pages of the same such
    lines) and pages without such lines passed over. Beside an article nothing else stays. Copies are passed
    over within a block and at its edges. Null pages are empty and have an empty
    text; pages without a url are ordered by what there is and form one host; of
    pages of equal host, path and id all get their text; texts may be of any length;
    other columns do not pass; no pages give no rows.
    """
    pages = pages.select("page_id", "url", "html")
    cuts = _boundaries(pages, blocks)
    shared = pages.sparkSession.sparkContext.broadcast(cuts)
    schema = "block int, ghost int, host string, path string, id string, page_id long, url string, states array<tinyint>, lines array<string>"
    names = [c.split()[0] for c in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [first for _, first in shared.value]
        lasts = {last: k for k, (last, _) in enumerate(shared.value)}
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for page_id, url, page in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                key = _key(url, page_id)
                block = bisect.bisect_right(firsts, key)
                lines = page_lines(page)
                to = [(block, 0)]
                if block and firsts[block - 1] == key:
                    to.append((block - 1, 1))
                if key in lasts:
                    to.append((lasts[key] + 1, 1))
                for b, ghost in to:
                    for cell, value in zip(rows, (b, ghost, *key, page_id, url, [s for s, _ in lines], [t for _, t in lines]), strict=True):
                        cell.append(value)
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int8()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        def open_lines(row):
            return [t for s, t in zip(row[7], row[8], strict=True) if s != MAIN]

        def batch_of(out):
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            text = [t or "" for t in cols[2]]
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

        # a run: neighbouring pages of a host with the same open lines; (host, lines, pages that differencing decides on)
        before = run = None
        out: list[tuple] = []

        def close(after):
            if run is not None and run[2]:
                near = [x[1] for x in (before, after) if x is not None and x[0] == run[0]]
                out.extend((page_id, url, main_text(lines, near)) for page_id, url, lines in run[2])

        for row in rows():
            host, own = row[2], open_lines(row)
            settled = MAIN in row[7] and DOUBTFUL not in row[7] or not own
            lines = list(zip(row[7], row[8], strict=True))
            if not row[1] and settled:
                out.append((row[5], row[6], main_text(lines, [])))
            if own:
                if run is None or run[0] != host or run[1] != own:
                    close((host, own))
                    before, run = run, (host, own, [])
                if not row[1] and not settled:
                    run[2].append((row[5], row[6], lines))
            if len(out) >= 500:
                yield batch_of(out)
                out.clear()
        close(None)
        yield batch_of(out)

    placed = pages.mapInArrow(parse, schema)
    return placed.repartition(len(cuts) // TASK_BLOCKS + 1, "block").sortWithinPartitions("block", "host", "path", "id").mapInArrow(difference, "page_id long, url string, text string, n_chars long")
