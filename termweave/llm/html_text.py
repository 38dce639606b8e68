"""Main text of pages by nearest-URL page differencing.

A page is cut into text lines, one for each block, each with its container (the chain of structural elements above it).
Pages of a host are sorted by URL path; each is compared with its neighbours on either side by the longest common
subsequence of lines (container and text), and shared lines are deleted. Where a page marks no content, so are the lines
of containers that are mostly shared across the host (TEMPLATE_SHARE of at least TEMPLATE_LINES), which removes rotating
adverts and notices. A neighbour of which a page shares NEAR_COPY of the characters or more is another copy of it and
tells nothing about templates: such pairs count neither for lines nor for containers.

Markup is the tie-break, in both directions. The contract wants an article whole, so prose (paragraphs, headings, plain
lists and tables) of marked content (article, else main) stays although shared; other lines there go if shared. Lines
that no neighbour shares go if they lie outside of marked content, or in elements that by name, role or class are menus,
page headers, footers, sidebars, notices, adverts, forms or comments; a class tells that if it is made of such a word and
general ones (related-posts, but not related-work). A line below a class that merely holds such a word goes if shared.

Pages with equal lines on one host are compared once, so copies neither hide a template nor delete each other. The order
by path is a range partitioning of small rows, which splits a host that holds a third of all pages; only each
partition's first and last row are looked at together.

Defined results: null html is empty and gives the empty text; a null or odd url belongs to the host '' and sorts by
itself; a page without neighbours loses no shared lines; repeated rows give equal results; empty tables give no rows;
other columns are ignored. A page of which differencing would delete all that markup keeps keeps it.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import block_number, cut, slices

TEMPLATE_SHARE = 0.5
TEMPLATE_LINES = 8
NEAR_COPY = 0.9
#: Pages with shared lines (and as many lines that change their texts), and template containers, that are broadcast at most; beyond, shuffles join them.
SMALL_PAGES = 100_000
#: Bits of a comparison that are kept for backtracking; longer pages are halved first.
LCS_BITS = 1 << 28

#: HTML's raw-text, void, block and structural elements, and names of what is no main text.
RAW = {"script", "style", "template", "noscript", "textarea", "title", "svg", "iframe", "object", "math", "select"}
BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li link main menu meta nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = {"br", "hr", "meta", "link", "img", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = HEADINGS | {"p", "blockquote", "pre"}
LISTS = {"ul", "ol", "table", "dl"}
PROSE = HEADINGS | {"p", "li", "ul", "ol", "dl", "dd", "dt", "blockquote", "pre", "figure", "figcaption", "table", "tbody", "thead", "tr", "td", "th"}
NOISE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "head"}
INLINE_NOISE = {"button", "label", "output", "progress", "meter"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "alertdialog", "menu", "menubar"}
NOISE_WORDS = set("ad ads adv advert advertisement advertising adbox adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription share sharing social sidebar aside widget related recommended recommendations breadcrumb breadcrumbs menu nav navbar navigation footer comment comments disqus replies reply respond pagination pager toolbar masthead topbar login signup search skip disclaimer copyright".split())
GENERAL_WORDS = set("a area article articles block body bottom box btn button buttons card cards container content entry footer form global group header holder icon icons info inline inner item items js left link links list main message module page panel photo post posts primary right row secondary section sidebar signup site slot text title top unit user wrap wrapper".split()) | NOISE_WORDS

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_CLASSES = re.compile(r"\.[^>]*")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

#: What a line is: of an element that is never main text, outside of marked content, below a class that holds a word of
#: such elements, prose of marked content, other lines of it, or of a page that marks none.
NOISE, OUTSIDE, SUSPECT, PROSE_LINE, INSIDE, UNMARKED = range(6)


def _doubt(classes: list[str]) -> int:
    """2 if a class names what is no main text, 1 if one merely holds such a word."""
    words = [set(re.split(r"[-_]+", c)) - {""} for c in classes]
    return max((2 if w <= GENERAL_WORDS or any(x.isdigit() for x in w) and {x for x in w if not x.isdigit()} <= GENERAL_WORDS else 1 for w in words if w & NOISE_WORDS), default=0)


def lines_of(html: str | None) -> list[tuple[str, str, int]]:
    """(container, text, kind) of each block with text, in page order."""
    html = html or ""
    out: list[tuple] = []
    stack: list[tuple[str, str, int, str, bool]] = []  # name, label, doubt, region, inline
    text: list[str] = []
    regions: set[str] = set()

    def flush() -> None:
        line = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if line:
            doubt, region = (stack[-1][2], stack[-1][3]) if stack else (0, "")
            if doubt < 2 and region:
                regions.add(region)
            inside = [s for s in stack if s[3] and s[0] not in ("article", "main")]
            plain = all(s[0] in PROSE and s[0] == s[1] for s in inside) or bool(inside) and inside[-1][0] in PARAGRAPHS
            out.append((">".join(s[1] for s in stack), line, doubt, region, plain))

    def close(names: set[str], within: set[str] = frozenset()) -> None:
        """End the innermost element of those names, unless one that is not of within lies between."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if within and stack[k][0] not in within:
                return

    at = 0
    while token := _TOKEN.search(html, at):
        text.append(html[at : token.start()])
        at = token.end()
        closing, opening = token[1], token[2]
        if closing:
            name = closing.lower()
            if name in BLOCKS or any(s[4] and s[0] == name for s in stack):
                flush()
                close({name})
        elif opening:
            name, attributes = opening.lower(), token[3]
            if name in BLOCKS:
                flush()
            if name in RAW and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            elif name not in VOID:
                found, classes, own = {}, [], 0
                if attributes.strip():
                    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
                    classes = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
                    own = _doubt(classes) if name not in ("html", "body", "main") else 0
                    if found.get("role", "").lower() in NOISE_ROLES or _HIDDEN.search(attributes):
                        own = 2
                inline = name not in BLOCKS
                if inline and own < 2 and name not in INLINE_NOISE and not any(s[4] and s[0] == name for s in stack):
                    continue
                if inline:
                    flush()
                elif closes := CLOSES.get(name):
                    close(closes, PROSE - LISTS)
                elif stack and stack[-1][0] == "p":
                    del stack[-1]
                if name == "body":
                    stack = [s for s in stack if s[0] == "html"]
                doubt, region = (stack[-1][2], stack[-1][3]) if stack else (0, "")
                if found.get("role", "").lower() == "main" and not region:
                    region = "main"
                if name in NOISE_TAGS or name in INLINE_NOISE or (name == "header" and not region):
                    own = 2
                if name == "article" or name == "main" and not region:
                    region = name
                stack.append((name, ".".join([name, *classes]), max(doubt, own), region, inline))
    text.append(html[at:])
    flush()
    content = "article" if "article" in regions else "main" if "main" in regions else None

    def kind(doubt: int, region: str, plain: bool) -> int:
        if doubt == 2:
            return NOISE
        if content and region != content:
            return OUTSIDE
        return SUSPECT if doubt else UNMARKED if not content else PROSE_LINE if plain else INSIDE

    return [(c, t, kind(doubt, region, plain)) for c, t, doubt, region, plain in out]


def _rows(a: list, b: list) -> list[int]:
    """Bit vectors over a after each item of b: a bit is 0 where the common subsequence grows."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    rows = []
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def _score(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of a and each prefix of b."""
    at: dict = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << i
    full = v = (1 << len(b)) - 1
    for y in a:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    out = [(i, i) for i in range(start)] + [(len(a) - k, len(b) - k) for k in range(end, 0, -1)]
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return out
    if len(a) * len(b) > LCS_BITS and len(a) > 1:
        half = len(a) // 2
        k = int(np.argmax(_score(a[:half], b) + _score(a[half:][::-1], b[::-1])[::-1]))
        middle = common_lines(a[:half], b[:k]) + [(i + half, j + k) for i, j in common_lines(a[half:], b[k:])]
    else:
        rows, i, j, middle = _rows(a, b), len(a), len(b), []
        while i and j:
            if rows[j - 1] >> (i - 1) & 1:
                i -= 1
            else:
                j -= 1
                if j and not rows[j - 1] >> (i - 1) & 1:
                    continue
                i -= 1
                middle.append((i, j))
    return sorted(out + [(i + start, j + start) for i, j in middle])


def host_and_path(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or ""), f"{parts.path}?{parts.query}" if parts.query else parts.path
    except ValueError:
        return "", url or ""


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _parsed(pages: DataFrame) -> DataFrame:
    """row, page_id, url, host, path, digest of host and lines, and per line: key, container, kind, length, text."""
    names = ["row", "page_id", "url", "host", "path", "digest", "keys", "containers", "kinds", "lengths", "texts"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.list_(pa.int32()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = block_number()
        for some in slices(batches, ("page_id", "url", "html"), "html"):
            out = []
            for page_id, url, html in zip(*some):
                lines = lines_of(html)
                host, path = host_and_path(url)
                keys = [_hash(_CLASSES.sub("", c), t) for c, t, _ in lines]
                digest = hashlib.blake2b(np.array([_hash(host), *keys], np.int64).tobytes() + bytes(k for *_, k in lines), digest_size=16).digest()
                out.append((row, page_id, url, host, path, digest, keys, [_hash(c) for c, _, _ in lines], [k for *_, k in lines], [len(t) for _, t, _ in lines], [t for _, t, _ in lines]))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    plain = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return cut(plain.mapInArrow(run, "row bigint, page_id bigint, url string, host string, path string, digest binary, keys array<bigint>, containers array<bigint>, kinds array<tinyint>, lengths array<int>, texts array<string>"), "pages-parsed")


def _neighbours(distinct: DataFrame) -> DataFrame:
    """(a, b): rows of distinct(host, path, row) that follow each other within a host, in the order of all three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            out = []
            for host, _, row in zip(*(c.to_pylist() for c in batch.columns)):
                out.append((part, host, row, last[1] if last and last[0] == host else None, last is None))
                last = (host, row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()))], names=["part", "host", "b", "a", "first"])
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, last[0], last[1], None, None), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()))], names=["part", "host", "b", "a", "first"])

    ordered = distinct.select("host", "path", "row").repartitionByRange("host", "path", "row").sortWithinPartitions("host", "path", "row")
    placed = cut(ordered.mapInArrow(run, "part bigint, host string, b bigint, a bigint, first boolean"), "pages-order")
    # two rows a partition: its first one (first is true) and its last one once more (first is null)
    ends = placed.where("first OR first IS NULL").withColumn("order", F.struct("part", F.col("first").isNull()))
    before = Window.orderBy("order")
    across = ends.withColumns({"a": F.lag("b").over(before), "of": F.lag("host").over(before)}).where("first AND of = host").select("a", "b")
    return placed.where("a IS NOT NULL").select("a", "b").unionByName(across)


def shared_lines(keys_a: list[int], keys_b: list[int], lengths_a: list[int], lengths_b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of the lines that two neighbours share; none if one is a near copy of the other."""
    shared = common_lines(keys_a, keys_b)
    return [] if sum(lengths_a[i] for i, _ in shared) >= NEAR_COPY * max(sum(lengths_a), sum(lengths_b)) else shared


def deletions(kinds: list[int], shared: set[int], template: set[int]) -> list[int]:
    """Lines that differencing deletes, given those that neighbours share and those of template containers."""
    drop = [i for i, k in enumerate(kinds) if i in shared and k != PROSE_LINE or k == UNMARKED and i in template]
    if any(k >= SUSPECT and i not in drop for i, k in enumerate(kinds)):
        return drop
    return [i for i in drop if kinds[i] < SUSPECT]  # a page of shared lines alone keeps them


def extract(pages: DataFrame, share: float = TEMPLATE_SHARE, least: int = TEMPLATE_LINES) -> DataFrame:
    """(page_id, url, text, n_lines, n_dropped) of every row of pages(page_id, url, html); n_dropped: lines that differencing deletes."""
    parsed = _parsed(pages)
    first = parsed.groupBy("digest").agg(F.min(F.struct("host", "path", "row")).alias("first")).select("digest", "first.*")
    distinct = cut(first, "pages-distinct")
    pairs = _neighbours(distinct)
    keys = parsed.select("row", "keys", "lengths")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, keys_a, lengths_a, keys_b, lengths_b in zip(*(c.to_pylist() for c in batch.columns)):
                shared = shared_lines(keys_a, keys_b, lengths_a, lengths_b)
                out += [(a, [i for i, _ in shared]), (b, [j for _, j in shared])] if shared else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([s for _, s in out], pa.list_(pa.int32()))], names=["row", "shared"])

    both = pairs.join(keys.toDF("a", "keys_a", "lengths_a"), "a").join(keys.toDF("b", "keys_b", "lengths_b"), "b").select("a", "b", "keys_a", "lengths_a", "keys_b", "lengths_b")
    # a row has at most two neighbours, so these lists are of at most two
    shared = both.mapInArrow(compare, "row bigint, shared array<int>").groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("shared")))).alias("shared"))
    shapes = distinct.join(parsed.select("row", "containers", "kinds"), "row").join(shared, "row", "left")
    shapes = cut(shapes.select("host", "digest", "shared", "containers", "kinds"), "pages-shared")

    unmarked = shapes.where(F.array_contains("kinds", F.lit(UNMARKED).cast("tinyint")))
    lines = unmarked.select("host", "digest", F.coalesce("shared", F.array().cast("array<int>")).alias("shared"), F.posexplode("containers").alias("at", "container"))
    same = F.array_contains("shared", F.col("at"))
    template = lines.groupBy("host", "container").agg(F.count("*").alias("n"), F.count_if(same).alias("n_shared")).where((F.col("n") >= least) & (F.col("n_shared") >= share * F.col("n")))
    templates = cut(template.select("host", "container"), "pages-templates")
    small = templates.limit(SMALL_PAGES + 1).count() <= SMALL_PAGES
    of_template = lines.join(F.broadcast(templates) if small else templates, ["host", "container"], "left_semi").groupBy("digest").agg(F.collect_list("at").alias("template"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many lines differencing deletes, and those of them that markup would keep."""
        for batch in batches:
            out = []
            for page, same, kinds, template in zip(*(c.to_pylist() for c in batch.columns)):
                drop = deletions(kinds, set(same or ()), set(template or ()))
                if drop:
                    out.append((page, len(drop), [i for i in drop if kinds[i] >= SUSPECT]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.list_(pa.int32())))], names=["digest", "n_dropped", "drop"])

    rows = shapes.join(of_template, "digest", "left").where("shared IS NOT NULL OR template IS NOT NULL").select("digest", "shared", "kinds", "template")
    drops = cut(rows.mapInArrow(choose, "digest binary, n_dropped bigint, drop array<int>"), "pages-drops")
    n, lines_dropped = drops.agg(F.count("*"), F.coalesce(F.sum(F.size("drop")), F.lit(0))).first()
    small = n <= SMALL_PAGES and lines_dropped <= SMALL_PAGES
    joined = parsed.join(F.broadcast(drops) if small else drops.hint("merge"), "digest", "left")
    kept = F.filter(F.transform("texts", lambda t, i: F.when((F.get(F.col("kinds"), i) >= SUSPECT) & ~F.coalesce(F.array_contains("drop", i), F.lit(False)), t)), lambda t: t.isNotNull())
    return joined.select("page_id", "url", F.array_join(kept, " ").alias("text"), F.size("kinds").cast("bigint").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"))


def brute_force(pages: list[tuple]) -> list[tuple]:
    """(page_id, text, n_lines, n_dropped) of (page_id, url, html) rows, with plain loops and a table for each comparison."""

    def pairs(a: list, b: list) -> list[tuple[int, int]]:
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
        i = j = 0
        out = []
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif table[i + 1][j] >= table[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    read = [(host_and_path(url), lines_of(html)) for _, url, html in pages]
    content = lambda lines: [(_CLASSES.sub("", c), t, k) for c, t, k in lines]
    groups: dict[str, list[int]] = {}
    for i, ((host, path), lines) in enumerate(read):
        if not any(content(lines) == content(read[j][1]) for j in groups.setdefault(host, [])):
            groups[host].append(i)
        else:
            j = next(j for j in groups[host] if content(lines) == content(read[j][1]))
            if path < read[j][0][1]:
                groups[host][groups[host].index(j)] = i
    shared: dict[int, set[int]] = {}
    for rows in groups.values():
        rows.sort(key=lambda i: (read[i][0][1].encode(), i))
        for a, b in zip(rows, rows[1:]):
            x, y = ([(_CLASSES.sub("", c), t) for c, t, _ in read[i][1]] for i in (a, b))
            same = pairs(x, y)
            if sum(len(x[i][1]) for i, _ in same) < NEAR_COPY * max(sum(len(t) for _, t in z) for z in (x, y)):
                shared.setdefault(a, set()).update(i for i, _ in same)
                shared.setdefault(b, set()).update(j for _, j in same)
    out = []
    for i, (page_id, _, _) in enumerate(pages):
        host, lines = read[i][0][0], read[i][1]
        one = next(j for j in groups[host] if content(read[j][1]) == content(lines))
        template = set()
        for at, (container, _, kind) in enumerate(lines):
            alike = [at2 in shared.get(j, ()) for j in groups[host] if any(k == UNMARKED for *_, k in read[j][1]) for at2, (c, _, _) in enumerate(read[j][1]) if c == container]
            if kind == UNMARKED and len(alike) >= TEMPLATE_LINES and sum(alike) >= TEMPLATE_SHARE * len(alike):
                template.add(at)
        drop = deletions([k for *_, k in lines], shared.get(one, set()), template)
        out.append((page_id, " ".join(t for at, (_, t, k) in enumerate(lines) if k >= SUSPECT and at not in drop), len(lines), len(drop)))
    return out


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of extract()."""
    return result.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_lines", "n_dropped")
