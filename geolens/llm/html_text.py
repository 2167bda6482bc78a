"""Main text of web pages: blocks by mark-up, then the difference to the page with the nearest URL.

A tolerant scanner cuts a page into blocks of text.  Blocks in elements that say they are no article (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments, scripts, hidden parts) are left out; blocks
in an article are kept.  What else is on the page - loose blocks - is settled by page differencing: pages are put
in order of host, path and id, each page is aligned with its nearest neighbour of the same host by the longest
common subsequence of their loose blocks, and shared blocks are deleted as parts of the host's template.  Pages of a
host with the same blocks say nothing about its template: they take one place in the order, that of their first
path, and get the same text, whatever their number and wherever they are.

The order is a global index over range partitions, and neighbours meet by an equi-join on it, so a host with a
third of all pages is spread over tasks.  Only hashes of loose blocks travel; texts stay where they were written.

Defined cases: null or empty html gives an empty text; a null url belongs to a host of its own name ""; repeated
pages are copies and each gets its row; pages cut off in the middle are read to their end; other columns are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolens.llm.words import chunks
from geolens.operators.spread import global_index
from geolens.session import cut_lineage

BROADCAST_ROWS = 500_000
TABLE_CELLS = 1 << 22
_GROUP = ["host", "page", "flags"]  # equal pages of a host

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>",  # a quote that nothing closes ends with the tag
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template textarea title iframe noembed noframes xmp object svg math canvas video audio select".split())
#: Of these only text that really ends them is skipped: without an end tag they are passed over as if empty.
_PASSED = set("noscript template iframe noembed noframes object svg math canvas video audio select".split())
_DROPPED = set("nav footer aside form button dialog menu head datalist".split())
_CONTENT = {"article", "main"}
_BLOCKS = set(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that may stand in a head; any other one ends a head without an end tag.
_HEAD = set("base basefont bgsound link meta noscript script style template title".split())
#: Elements that a following element closes.
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status".split())
_NAMES = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert "
    "newsletter subscribe subscription signup popup modal overlay sidebar widget widgets nav navbar navigation menu breadcrumb breadcrumbs pagination "
    "pager footer masthead comment comments disqus respond reply replies share sharing social related recommended recommendations toolbar login search "
    "skip offscreen".split()
)
_COMMENTS = {"comment", "comments", "disqus", "reply", "replies"}


#: Parts of a compound name that say what it is for, not what it is about; those that turn its sense around.
_GENERIC = set("area bar block box btn button container content group inner item items link links list module outer panel row section slot unit wrap wrapper zone".split())
_NEGATING = set("has no non not with without is js hide show".split())


def _says(value: str, names: set[str]) -> bool:
    """A class or id whose whole name is one of the names, ends in one, or is one of a generic part."""
    for token in value.lower().split():
        parts = [x for x in re.split(r"[^a-z]+", token) if x]
        if not parts or parts[0] in _NEGATING:
            continue
        while len(parts) > 1 and parts[-1] in _GENERIC:
            parts.pop()
        if parts[-1] in names:
            return True
    return False


class _Open:
    __slots__ = ("comments", "content", "drop", "name")

    def __init__(self, name: str, drop: bool, content: bool, comments: bool = False):
        self.name, self.drop, self.content = name, drop, content
        self.comments = comments  # reader comments or hidden: articles in it are none of the page's


def _attributes(rest: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'")) if value else "")
    return out


def _opened(name: str, rest: str, in_content: bool) -> _Open:
    content = name in _CONTENT
    drop = name in _DROPPED or (name == "header" and not in_content)
    comments = False
    if rest.strip(" \t\r\n/"):
        attributes = _attributes(rest)
        role = attributes.get("role", "").lower()
        classes, own = attributes.get("class", ""), attributes.get("id", "")
        content |= role == "main" or attributes.get("itemprop") == "articleBody"
        style = attributes.get("style", "").replace(" ", "").lower()
        drop |= role in _ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style
        comments = hidden or _says(classes, _COMMENTS) or _says(own, _COMMENTS)
        if name in ("html", "body"):
            drop = comments = False
        elif name in _CONTENT:
            drop |= _says(classes, _COMMENTS) or _says(own, _COMMENTS)
        elif in_content:  # the id of a part of an article names its subject
            drop |= _says(classes, _NAMES) or _says(own, _COMMENTS)
        else:
            drop |= _says(classes, _NAMES | {"header"}) or _says(own, _NAMES | {"header"})
    return _Open(name, drop, content, comments)


def blocks(page: str) -> list[tuple[str, bool]]:
    """(text, loose) of each block outside dropped elements; loose: not in an article.

    Where all articles of a page are inside dropped elements, what encloses them is no furniture (a form around the
    whole page, a layout named after its sidebar): then the elements that hold the first one are kept.
    """
    found, held = _scan(page, frozenset())
    if held and all(loose for _, loose in found):
        found, _ = _scan(page, held)
    return found


def _scan(page: str, spared: frozenset[int]) -> tuple[list[tuple[str, bool]], frozenset[int]]:
    """Blocks, and the places of the dropped elements around the first article found inside some.

    Elements at the places ``spared`` are not dropped.  An article in reader comments is none.
    """
    out: list[tuple[str, bool]] = []
    text: list[str] = []
    stack: list[_Open] = []
    places: list[int] = []
    held: frozenset[int] = frozenset()
    dropped = content = 0

    def flush() -> None:
        if text:
            said = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if said:
                out.append((said, not content))

    def close(down_to: int) -> None:
        nonlocal dropped, content
        if any(x.name in _BLOCKS or x.drop for x in stack[down_to:]):
            flush()
        for x in stack[down_to:]:
            dropped -= x.drop
            content -= x.content
        del stack[down_to:], places[down_to:]

    at = 0
    while True:
        token = _TOKEN.search(page, at)
        if not dropped:
            piece = page[at : token.start()] if token else page[at:]
            if piece:
                text.append(piece)
        elif stack and stack[-1].name == "head" and (piece := page[at : token.start()] if token else page[at:]).strip():
            close(len(stack) - 1)  # so does text
            if not dropped:
                text.append(piece)
        if token is None:
            break
        at = token.end()
        if token["name"] is None and token["name2"] is None:
            continue
        name, rest = (token["name"] or token["name2"]).lower(), token["rest"] if token["name"] else token["rest2"]
        ends = token["end"] or token["end2"]
        if stack and stack[-1].name == "head" and not ends and name not in ("html", "head", *_HEAD):
            close(len(stack) - 1)
        if ends:
            if name == "br":
                text.append(" ")
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    close(i)
                    break
                if stack[i].content and name not in ("body", "html", *_CONTENT):
                    break  # a stray end tag doesn't end the article
            else:
                if name in _BLOCKS:
                    flush()
            continue
        if name in _RAW:
            if not rest.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else at if name in _PASSED else len(page)
            if not dropped:
                text.append(" ")
            continue
        if name in _VOID:
            if not dropped:
                if name == "hr":
                    flush()
                else:
                    text.append(" " if name == "br" else "")
            continue
        if name in _BLOCKS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == "p" or stack[i].name in _CLOSED_BY and name in _CLOSED_BY[stack[i].name]:
                    close(i)
                    break
                if stack[i].name in _BLOCKS:
                    break
        new = _opened(name, rest, content > 0)
        if token.start() in spared:
            new.drop = False
        if name in _BLOCKS or new.drop:
            flush()
        if new.content and not new.drop and dropped and not held and not any(x.comments for x in stack):
            held = frozenset(p for x, p in zip(stack, places, strict=True) if x.drop)
        stack.append(new)
        places.append(token.start())
        dropped += new.drop
        content += new.content
    close(0)
    flush()
    return out, held


def host_and_path(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").removeprefix("www."), f"{parts.path or '/'}?{parts.query}"
    except ValueError:
        return "", url or ""


def parse_pages(pages: DataFrame) -> DataFrame:
    """(row, page_id, url, host, path, texts, loose) of each page."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                found = [blocks(x or "") for x in part.column("html").to_pylist()]
                places = [host_and_path(x) for x in part.column("url").to_pylist()]
                arrays = [
                    part.column("page_id"),
                    part.column("url"),
                    pa.array([x[0] for x in places], pa.string()),
                    pa.array([x[1] for x in places], pa.string()),
                    pa.array([[t for t, _ in x] for x in found], pa.list_(pa.string())),
                    pa.array([[k for _, k in x] for x in found], pa.list_(pa.bool_())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "host", "path", "texts", "loose"])

    plain = pages.select("page_id", "url", "html")
    kind = plain.schema["page_id"].dataType.simpleString()
    parsed = plain.mapInArrow(parse, f"page_id {kind}, url string, host string, path string, texts array<string>, loose array<boolean>")
    return parsed.select(F.monotonically_increasing_id().alias("row"), "*")


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with each prefix of ``b``."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        best = np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0))
        row[1:] = np.maximum.accumulate(best)
    return row


def shared_places(mine: np.ndarray, theirs: np.ndarray) -> list[int]:
    """Places in ``mine`` of a longest common subsequence with ``theirs``; memory is bounded by ``TABLE_CELLS``."""
    n, m = len(mine), len(theirs)
    head = 0
    while head < min(n, m) and mine[head] == theirs[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and mine[n - 1 - tail] == theirs[m - 1 - tail]:
        tail += 1
    a, b = mine[head : n - tail], theirs[head : m - tail]
    known = np.isin(a, b)
    places = np.flatnonzero(known)
    a = a[known]
    b = b[np.isin(b, a)]
    middle: list[int] = []
    if len(a) * len(b) > TABLE_CELLS and len(a) > 1:
        # Split the longer task where the two halves' lengths add up best: two rows of the table at a time.
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        for first, x, y in ((0, a[:half], b[:cut]), (half, a[half:], b[cut:])):
            middle += [head + int(places[first + k]) for k in shared_places(x, y)]
    elif len(a):
        # row i: lengths for a[i:], found from the end, one numpy pass for each row
        table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
        for i in range(len(a) - 1, -1, -1):
            best = np.maximum(table[i + 1, :-1], np.where(b == a[i], table[i + 1, 1:] + 1, 0))
            table[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
        i = j = 0
        while i < len(a) and j < len(b):
            if a[i] == b[j] and table[i, j] == table[i + 1, j + 1] + 1:
                middle.append(head + int(places[i]))
                i, j = i + 1, j + 1
            elif table[i, j + 1] == table[i, j]:
                j += 1
            else:
                i += 1
    return [*range(head), *middle, *range(n - tail, n)]


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _grouped(parsed: DataFrame) -> DataFrame:
    return parsed.withColumns({"page": F.xxhash64("texts"), "flags": F.xxhash64("loose")})


def template_blocks(parsed: DataFrame) -> DataFrame:
    """(_GROUP, deleted): places among a page's loose blocks that its nearest page shares, for groups that have some."""
    hashes = F.transform(F.filter(F.arrays_zip("texts", "loose"), lambda x: x["loose"]), lambda x: F.xxhash64(x["texts"]))
    keys = _grouped(parsed).select("row", "path", *_GROUP, hashes.alias("loose"))
    keys = keys.groupBy(*_GROUP).agg(F.min("row").alias("row"), F.min("path").alias("path"), F.first("loose").alias("loose"))
    order = [F.col("host"), F.col("path"), F.col("row")]
    indexed = cut_lineage(global_index(keys, order, "place"))
    other = indexed.select(F.struct("host", "path", "loose", "page").alias("other"), "place")
    before = other.select(F.col("other").alias("before"), (F.col("place") + 1).alias("place"))
    after = other.select(F.col("other").alias("after"), (F.col("place") - 1).alias("place"))
    asking = indexed.filter(F.size("loose") > 0).join(before, "place", "left").join(after, "place", "left")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_in, deleted = [], []
            for start in range(0, batch.num_rows, 500):
                for r in batch.slice(start, 500).to_pylist():
                    near = [x for x in (r["before"], r["after"]) if x and x["host"] == r["host"] and x["page"] != r["page"]]
                    if near:
                        nearest = max(near, key=lambda x: _common(x["path"], r["path"]))  # the earlier one of two as near
                        if found := shared_places(np.array(r["loose"], np.int64), np.array(nearest["loose"], np.int64)):
                            found_in.append(r)
                            deleted.append(found)
            keys = [pa.array([r[k] for r in found_in], kind) for k, kind in zip(_GROUP, (pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.record_batch([*keys, pa.array(deleted, pa.list_(pa.int32()))], [*_GROUP, "deleted"])

    schema = "host string, page long, flags long, deleted array<int>"
    return asking.select(*_GROUP, "path", "loose", "before", "after").mapInArrow(align, schema)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    parsed = cut_lineage(parse_pages(pages))
    deleted = cut_lineage(template_blocks(parsed))
    marked = _grouped(parsed).join(F.broadcast(deleted) if deleted.count() <= BROADCAST_ROWS else deleted, _GROUP, "left")
    # the number of a loose block among the loose ones, to look it up in `deleted`
    numbered = F.transform("texts", lambda t, i: F.struct(t.alias("text"), F.element_at("loose", i + 1).alias("loose"), F.size(F.filter(F.slice("loose", 1, i), lambda x: x)).alias("place")))
    kept = F.when(F.col("deleted").isNull(), F.col("texts")).otherwise(
        F.transform(F.filter(numbered, lambda b: ~(b["loose"] & F.array_contains("deleted", b["place"]))), lambda b: b["text"])
    )
    text = F.array_join(kept, "\n\n")
    return marked.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
