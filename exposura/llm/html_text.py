"""Main text of web pages by differencing each page with the page nearest in URL.

A page is parsed into blocks of text. Within its host it is paired with the neighbour in path order that shares the
longer start of the path, or with both where they are equally near; the blocks of the two are aligned by a longest common subsequence, and blocks in common are
what the site repeats on its pages, so they are deleted. Elements whose kind or name says that they are no article
(menus, headers, footers, sidebars, notices, adverts, forms, comments) are left out in any case. An article element
is evidence only for keeping what is repeated: its paragraphs and headings stay although a neighbour has them too, unless
the neighbour has all of it and the page has more text of its own elsewhere (a card or teaser). All other text, that of
a main element included, stays where no neighbour has it. A page whose blocks are all shared, a copy under another URL,
keeps the paragraphs of its articles, else those of its main element, else what is visible.
"""

from __future__ import annotations

import html
import re
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from exposura.llm.url_filter import url_parts
from exposura.session import materialize

# HTML elements by how their text counts.
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LEFT_OUT = frozenset(
    "aside button dialog footer form head iframe map menu nav noscript object select svg template textarea".split()
)
_RAW = "script|style|textarea|title|noscript|iframe|template|svg|xmp"
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
# Names of what is no article, with words that may stand before and behind them in a class or an id. A name counts only as
# a whole: "has-sidebar" or "header-fixed" say how a wrapper is laid out.
_NAME = (
    r"(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|newsletter|subscribe|"
    r"subscription|comments?|commentlist|disqus|respond|replies|reply|menu|nav|navbar|navigation|breadcrumbs?|sidebar|widgets?|"
    r"footer|header|masthead|related|recommend\w*|share|sharing|social|popup|modal|overlay|login|signup|search|toolbar|"
    r"pagination|pager|skip)"
)
_PLACE = "(?:site|page|main|top|bottom|global|left|right|primary|secondary|blog|post|article|entry|user|reader|wp|block|mobile|sticky)"
_PART = (
    r"(?:box|bar|list|wrap|wrapper|container|section|area|block|inner|links?|items?|form|message|unit|slot|group|panel|content|"
    r"thread|posts?|stories|articles|text|top|bottom|left|right|buttons?|icons?|media|\d+)"
)
_WHOLE_NAME = re.compile(rf"(?:{_PLACE}[-_]?)*{_NAME}(?:[-_]*(?:{_NAME}|{_PART}))*")
# An article has headers and footers of its own.
_OF_ARTICLES = re.compile(rf"(?:{_PLACE}[-_]?)*(?:header|footer|masthead|skip|search)(?:[-_]*{_PART})*")
# Lists of comments and of other articles may hold article elements.
_OF_OTHERS = re.compile(rf"(?:{_PLACE}[-_]?)*(?:comments?|commentlist|disqus|respond|replies|reply|related|recommend\w*)(?:[-_]*{_PART})*")
# Headings and sections are named after what they are about, so their ids, and all names of paragraphs, count only if clear.
_CLEAR_NAMES = re.compile(
    rf"(?:ads?|adbox|advert|advertisement|sponsored|comments|commentlist|disqus|share|sharing|social|newsletter|breadcrumbs|pagination)"
    rf"(?:[-_]{_PART})*"
)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")

# Left out by kind; visible; a paragraph of an article; other text of an article; a paragraph of a main element.
OTHER, BODY, PROSE, LOOSE, MAIN = range(5)
KINDS = 8  # a block's mark is its kind and this times the number of its article on the page, from one


STAYS, LEFT, NAMED, NAMED_OTHERS = range(4)


def _left_out(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element is left out by its kind (LEFT) or only by its name, which its contents may overrule."""
    if tag in _LEFT_OUT or (tag == "header" and not in_article):
        return LEFT
    if not attributes or tag in ("html", "body", "article", "main"):
        return STAYS
    found = STAYS
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in _ROLES:
            return LEFT
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return LEFT
        if name == "style" and "display:none" in value.replace(" ", ""):
            return LEFT
        if name not in ("class", "id") or (name == "id" and tag in _PROSE):
            continue
        clear_only = tag in _PROSE or (name == "id" and tag == "section")
        for token in value.split():
            token = token.strip("-_")
            if _CLEAR_NAMES.fullmatch(token) or (
                not clear_only and _WHOLE_NAME.fullmatch(token) and not (in_article and _OF_ARTICLES.fullmatch(token))
            ):
                found = max(found, NAMED_OTHERS if _OF_OTHERS.fullmatch(token) else NAMED)
    return found


def page_blocks(page: str) -> list[tuple[str, int]]:
    """The text blocks of a page in order, each with its mark.

    An element that is left out by its name stays where it turns out to hold an article or a main element (unless it
    is named a list of comments or of other articles), or, on a page without either, most of the text.
    """
    blocks: list[tuple[str, int]] = []
    named: list[tuple[int, tuple[int, ...], int]] = []  # blocks that only names leave out: block, elements, mark if they stay
    # tag, left out by kind, inside article or main, prose, number of the article, elements left out by name
    stack: list[tuple[str, bool, bool, bool, int, tuple[int, ...]]] = []
    parts: list[str] = []
    at = articles = elements = 0
    others, holders, bodies = set(), set(), 0

    def close():
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            _, out, inside, prose, article, names = stack[-1] if stack else ("", False, False, False, 0, ())
            mark = (PROSE if prose else LOOSE) + KINDS * article if article else MAIN if inside and prose else BODY
            if names and not out:
                named.append((len(blocks), names, mark))
            blocks.append((text, OTHER if out or names else mark))

    for token in _TOKEN.finditer(page):
        if token.start() > at:
            parts.append(page[at:token.start()])
        at = token.end()
        tag = token[3]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in _BLOCKS
        if block:
            close()
        elif tag == "br":
            parts.append(" ")
        if token[2]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if place is not None:
                if any(one[1] or one[5] or one[0] in _BLOCKS for one in stack[place:]):
                    close()
                del stack[place:]
            continue
        if tag in _VOID or token[4].endswith("/"):
            continue
        if block:  # a new block ends an open paragraph, and an item ends the one before
            ends = {"p", tag} if tag in ("li", "dd", "dt", "option", "tr", "td", "th") else {"p"}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                    break
                if stack[i][0] in _BLOCKS:
                    break
        _, out, inside, prose, article, names = stack[-1] if stack else ("", False, False, False, 0, ())
        leaves = _left_out(tag, token[4], inside)
        if leaves and not out:
            close()
        if leaves in (NAMED, NAMED_OTHERS):
            elements += 1
            names = (*names, elements)
            if leaves == NAMED_OTHERS:
                others.add(elements)
        if tag in ("article", "main") and not out and others.isdisjoint(names):
            bodies += 1
            holders.update(names)
        if tag == "article" and not article:
            articles += 1
            article = articles
        stack.append((tag, out or leaves == LEFT, inside or tag in ("article", "main"), prose or tag in _PROSE, article, names))
    parts.append(page[at:])
    close()
    if named and not bodies:
        size = sum(len(text) for text, mark in blocks if mark != OTHER)
        for element in {e for _, names, _ in named for e in names} - others:
            held = sum(len(blocks[i][0]) for i, names, _ in named if element in names)
            if held > size:
                holders.add(element)
    for i, names, mark in named:
        if holders.issuperset(names):
            blocks[i] = (blocks[i][0], mark)
    return blocks




# Bits of rows that one alignment keeps at most; longer ones are split in two first.
_KEPT_BITS = 1 << 26


def _rows(a: list[int], b: list[int], keep: bool) -> list[int]:
    """Rows of bits of the alignment of ``a`` and ``b``: zeros among the first j bits are the common length with b[:j]."""
    where: dict[int, int] = {}
    for j, value in enumerate(b):
        where[value] = where.get(value, 0) | (1 << j)
    full = bits = (1 << len(b)) - 1
    rows = [bits]
    for value in a:
        hit = bits & where.get(value, 0)
        bits = ((bits + hit) | (bits - hit)) & full
        if keep:
            rows.append(bits)
    return rows if keep else [bits]


def _lengths(bits: int, count: int) -> np.ndarray:
    """Zeros among the first 0, 1, … ``count`` bits."""
    raw = np.frombuffer(bits.to_bytes(count // 8 + 1, "little"), np.uint8)
    return np.r_[0, np.cumsum(1 - np.unpackbits(raw, bitorder="little")[:count].astype(np.int64))]


def common_blocks(a: list[int], b: list[int]) -> np.ndarray:
    """Which entries of ``a`` lie on a longest common subsequence with ``b``.

    What the two share at their beginnings and ends is set aside. The rest keeps one row of bits for each entry of ``a``
    up to ``_KEPT_BITS``; beyond that it is cut in two where the halves' common lengths add up to most, so memory stays
    in proportion to the two lengths.
    """
    flags = np.zeros(len(a), bool)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    flags[:head] = True
    flags[len(a) - tail:] = True
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    if not a or not b:
        return flags
    if len(a) > 1 and len(a) * len(b) > _KEPT_BITS:
        middle = len(a) // 2
        before = _lengths(_rows(a[:middle], b, False)[0], len(b))
        behind = _lengths(_rows(a[:middle - 1:-1], b[::-1], False)[0], len(b))[::-1]
        cut = int(np.argmax(before + behind))
        own = np.r_[common_blocks(a[:middle], b[:cut]), common_blocks(a[middle:], b[cut:])]
    else:
        own = _traced(a, b)
    flags[head:head + len(a)] = own
    return flags


def _traced(a: list[int], b: list[int]) -> np.ndarray:
    flags, rows = np.zeros(len(a), bool), _rows(a, b, True)

    def length(i, j):  # zeros among the first j bits
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    i, j = len(a), len(b)
    while i and j and length(i, j):
        here = length(i, j)
        if length(i - 1, j) == here:
            i -= 1
        elif length(i, j - 1) == here:
            j -= 1
        else:
            i, j = i - 1, j - 1
            flags[i] = True
    return flags


def _parse(batches):
    for batch in batches:
        texts, kinds = [], []
        for page in batch.column(2).to_pylist():
            blocks = page_blocks(page or "")
            texts.append([t for t, _ in blocks])
            kinds.append([k for _, k in blocks])
        lists = pa.array(texts, pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), lists, pa.array(kinds, pa.list_(pa.int32()))],
            ["page_id", "url", "row", "texts", "kinds"],
        )


def _shared(names, path, before, after) -> list[bool]:
    """Blocks in common with the nearer of two neighbours ``(path, names)``; with either where both are equally near."""
    both = [(len(commonprefix([path, one[0]])), one[1]) for one in (before, after) if one is not None]
    flags = np.zeros(len(names), bool)
    for alike, other in both:
        if alike == max(both, key=lambda one: one[0])[0]:
            flags |= common_blocks(list(names), list(other))
    return flags.tolist()


_NEIGHBOUR = pa.struct([("path", pa.string()), ("names", pa.list_(pa.int64()))])


def _difference(batches):
    """Over rows ``(host, path, row, names)`` in order: each row's shared flags, and the ends of the partition as they are.

    An end comes with its neighbour inside the partition, if that is of the same host.
    """
    part = TaskContext.get().partitionId()
    kinds = [pa.int64(), pa.list_(pa.bool_()), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), _NEIGHBOUR]

    def out(rows):
        columns = [pa.array([r[i] if i < len(r) else None for r in rows], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, ["row", "shared", "part", "side", "host", "path", "names", "inner"])

    def near(one, here):
        return None if one is None or one[0] != here[0] else (one[1], one[3])

    def end(side, here, inner):
        found = near(inner, here)
        return (here[2], None, part, side, here[0], here[1], here[3], found and {"path": found[0], "names": found[1]})

    before = here = first = second = None  # (host, path, row, names)
    for batch in batches:
        done = []
        for after in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if here is None:
                first = after
            else:
                second = second or after
                done.append((here[2], _shared(here[3], here[1], near(before, here), near(after, here))))
            before, here = here, after
        yield out(done)
    if here is not None:
        yield out([
            (here[2], _shared(here[3], here[1], near(before, here), None)), end(0, first, second), end(1, here, before),
        ])


def shared_blocks(parsed: DataFrame) -> DataFrame:
    """``row, shared``: which blocks of each page its nearest neighbour has in common. ``parsed``: row, host, path, names.

    Pages are range-partitioned by host and path, so a host with very many pages takes many tasks. The first and last
    page of each partition meet their neighbours across the border in a second step of two rows for each partition.
    """
    ordered = parsed.select("host", "path", "row", "names").repartitionByRange("host", "path", "row").sortWithinPartitions("host", "path", "row")
    found = materialize(ordered.mapInArrow(
        _difference, "row long, shared array<boolean>, part long, side long, host string, path string, names array<long>, "
        "inner struct<path:string,names:array<long>>",
    ))
    line = Window.orderBy("part", "side")
    across = found.where("part is not null")
    columns = ["host", "path", "names", "row"]
    ends = across.select("*", *[F.lag(c).over(line).alias(f"{c}_0") for c in columns], *[F.lead(c).over(line).alias(f"{c}_1") for c in columns])

    def neighbour(side):  # across the border for one end, inside the partition for the other
        across_it = (F.col("side") == side) & (F.col("host") == F.col(f"host_{side}")) & (F.col("row") != F.col(f"row_{side}"))
        outer = F.when(across_it, F.struct(F.col(f"path_{side}").alias("path"), F.col(f"names_{side}").alias("names")))
        return F.first(F.coalesce(outer, F.when(F.col("side") != side, F.col("inner"))), ignorenulls=True)

    # a page alone in its partition has two entries
    ends = ends.groupBy("row").agg(
        F.first("path").alias("path"), F.first("names").alias("names"), neighbour(0).alias("before"), neighbour(1).alias("after")
    )

    def compared(batches):
        for batch in batches:
            rows = []
            for path, names, *near in zip(*[batch.column(i).to_pylist() for i in range(1, 5)]):
                rows.append(_shared(names, path, *[None if one is None else (one["path"], one["names"]) for one in near]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.bool_()))], ["row", "shared"])

    changed = ends.mapInArrow(compared, "row long, shared array<boolean>")
    inside = found.where("part is null").select("row", "shared")
    return inside.join(ends.select("row"), "row", "left_anti").unionByName(changed)


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: ``page_id, url, text, n_chars``.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed in
    page order. A null or empty page has an empty text. Pages with a null URL form a host of their own. ``pages`` has to
    be a stored table, because rows are numbered by its files. Repeated rows give repeated rows, other columns are
    ignored, an empty table gives an empty result.
    """
    numbered = pages.select("page_id", "url", "html").withColumn("row", F.monotonically_increasing_id())
    host, path = url_parts(F.col("url"))
    # one pass over the pages: what is parsed is stored without the markup
    parsed = materialize(
        numbered.mapInArrow(_parse, "page_id long, url string, row long, texts array<string>, kinds array<int>")
        .withColumns({"host": host, "path": path, "names": F.transform("texts", lambda t: F.xxhash64(t))})
    )
    shared = shared_blocks(parsed.select("row", "host", "path", "names"))
    none = F.array().cast("array<boolean>")
    block = F.transform("texts", lambda t, i: F.struct(
        t.alias("text"), (F.get("kinds", i) % KINDS).alias("kind"), F.floor(F.get("kinds", i) / KINDS).alias("article"),
        F.coalesce(F.get(F.coalesce("shared", none), i), F.lit(False)).alias("shared"),
    ))
    # only where a block's fate hangs on a neighbour do texts meet the flags; paragraphs of one article and nothing else stay
    hangs = F.exists("kinds", lambda k: (k != OTHER) & (k != PROSE + KINDS))
    settled = parsed.where(~hangs).withColumn("shared", none)
    open_ones = parsed.where(hangs).join(shared, "row", "left").select(*settled.columns)
    blocks = settled.unionByName(open_ones).select("page_id", "url", F.filter(block, lambda b: b["kind"] != OTHER).alias("blocks"))

    def size(some):
        return F.aggregate(some, F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"]))

    def of_kind(kind):
        return F.filter("blocks", lambda b: b["kind"] == kind)

    blocks = blocks.withColumn("own", F.filter("blocks", lambda b: ~b["shared"])).withColumn("own_size", size("own"))
    numbers = F.filter(F.array_distinct(F.transform("blocks", lambda b: b["article"])), lambda a: a > 0)
    blocks = blocks.withColumn("articles", F.filter(numbers, lambda a: (
        F.exists("own", lambda b: b["article"] == a) | (size(F.filter("blocks", lambda b: b["article"] == a)) >= F.col("own_size"))
    )))
    mine = F.filter("blocks", lambda b: ~b["shared"] | ((b["kind"] == PROSE) & F.array_contains("articles", b["article"])))
    kept = F.when(F.size(mine) > 0, mine).when(F.size(of_kind(PROSE)) > 0, of_kind(PROSE)).when(
        F.size(of_kind(MAIN)) > 0, of_kind(MAIN)
    ).otherwise(F.col("blocks"))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return blocks.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
