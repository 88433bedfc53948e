"""Main text of web pages: a suffix array over each host's page token streams, with structure as a hint.

Every page becomes a stream of text blocks; scripts, styles and other silent elements have none. Blocks in
menus, headers, footers, sidebars, notices, adverts, forms or reader comments, told by element, role or a
class or id whose noun names such a part (``reader-comments``, not ``no-sidebar`` or ``related-work``), are
``BESIDE``; a form around the page's main text isn't such a part. Blocks in an article, or in a main or content
element that holds no article, are ``INSIDE``. Where a page has these, its other blocks are ``BESIDE`` too, else
they are ``PLAIN``. Headlines (an h1, or what the title begins with) are ``HEADLINE``. All blocks make up the
page's token stream, and the streams of a host are searched for strings of RUN tokens that PAGES distinct pages
or more share; a longer string is covered by those in it.

1. Streams are packed into slices in bundle files, written once; later steps move small rows only. As in
   suffix_dedup, a string's anchor is its gram of GRAM tokens of least hash, so equal strings have equal
   anchors, and only suffixes that begin at an anchor are sorted. Of a slice, the distinct anchors' hashes
   go to hash ranges, which tell which occur often enough.
2. Those suffixes are range-partitioned by host and leading tokens (then by page, so the suffixes of a large
   host or a frequent string lie in many partitions) and sorted. Neighbours with equal leading tokens are
   compared string by string and the distinct pages that have a string are counted.
3. Strings of the groups at a partition's ends are counted across partitions by an aggregation.
4. Per page: BESIDE blocks go, HEADLINE blocks stay whole. Of PLAIN blocks the covered runs are cut and the
   unique runs stay. INSIDE blocks lose runs only if more than one in HALF of the host's distinct pages have
   them, and MANY at least, since a few articles may quote the same passage.

Pages of equal token streams are one distinct page, so a page copied to any number of addresses keeps its
text. Null html gives an empty text; null urls share one host. Character references are decoded, white space
within a block becomes one space, blocks are joined by one line break. Repeated rows are pages of their own;
columns other than page_id, url and html are ignored. An empty table gives no rows. A tag that the page's end
cuts off is text; from a tag whose quotes don't end on, a page's tags end at their first ``>``. A page takes time
in proportion to its length, however broken it is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.llm.common import checked, claim, scratch, table, text_slices, written
from navspark.llm.suffix_dedup import RANGE_KEYS, SORT_BYTES, range_of, sliding_least
from navspark.llm.textcore import U, Words, buffers, mix, prefix_hash, span_hash
from navspark.llm.warc import place

#: Tokens of a string and of its anchor's gram.
RUN, GRAM = 8, 4
W = RUN - GRAM + 1
#: Distinct pages of a host that a string of boilerplate is on, at least; one on fewer may be a copied passage.
PAGES = 3
#: In a marked article it is on more than one of HALF of the host's distinct pages, and on MANY at least.
HALF, MANY = 2, 5
BESIDE, PLAIN, INSIDE, HEADLINE = 0, 1, 2, 3
#: Elements whose contents are never text of the page.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "title", "head"}
#: Elements around the main text.
AROUND = {"nav", "footer", "aside", "menu", "dialog", "button"}
#: What may stand in a head; any other element ends it, and so does text.
HEAD = {"base", "link", "meta", "title", "style", "script", "noscript", "template", "head", "html"}
#: Roles of such parts.
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
#: Words of class or id that name such parts.
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promotion", "related", "replies", "reply", "responses", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar"}
#: Of these, what is beside the text only outside of an article.
HEADERS = {"header", "masthead"}
#: Words behind a name that leave it the noun of a class or id, and words that deny what follows.
CASES = {"area", "bar", "block", "box", "button", "buttons", "column", "container", "form", "icons", "inner", "item", "items", "left", "links", "list", "message", "outer", "panel", "posts", "right", "section", "slot", "stories", "unit", "widget", "wrap", "wrapper"}
DENIALS = {"has", "hide", "no", "non", "not", "with", "without"}
#: Whole classes and ids that name the main text.
MAIN = {"content", "main-content", "article-body", "article-content", "entry-content", "post-body", "post-content", "story-body"}
#: Elements that begin a new block.
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Elements without contents.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: What an opening of the key implicitly closes.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

OPENING = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: A tag's attributes up to its end: a quote only counts at the beginning of a value.
ATTRIBUTES = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
SPACE = re.compile(r"\s+")
RAW_TEXT = {name: re.compile(f"</{name}(?![^\\s/>])", re.I | re.A) for name in ("script", "style", "textarea", "title", "noscript", "iframe")}


def _names(token: str, within: bool) -> bool:
    """Whether a class or id names a part beside the main text by its noun; within: it stands in an article."""
    words = [w.lower() for w in WORD.findall(token)]
    while len(words) > 1 and words[-1] in CASES:
        words.pop()
    return bool(words) and words[-1] in NAMES and DENIALS.isdisjoint(words) and not (within and words[-1] in HEADERS)


def _part(name: str, attributes: str, within: bool) -> tuple[bool, bool]:
    """Whether an element is a part beside the main text, and whether it marks the main text."""
    beside = name in AROUND or (name == "header" and not within)
    if beside or not attributes:
        return beside, name == "main"
    found: dict[str, str] = {}
    for k, v in ATTRIBUTE.findall(attributes):
        found.setdefault(k.lower(), v[1:-1] if v[:1] in ("'", '"') else v)
    role, own = found.get("role", "").lower(), [*found.get("class", "").split(), *found.get("id", "").split()]
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or role in ROLES:
        return True, False
    marks = name == "main" or role == "main" or (name in ("div", "section", "td") and not MAIN.isdisjoint(t.lower() for t in own))
    return not marks and name not in ("html", "body", "main", "h1") and any(_names(t, within) for t in own), marks


def _tags(page: str) -> Iterator[tuple[int, int, str, str | None]]:
    """(start, end, name, attributes) of each tag, a closing one's attributes null, and of comments and the like with an empty name; to send a place goes on there."""
    at, size, quoted = 0, len(page), True
    last, data = page.rfind(">"), page.rfind("]]>")
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, "", None
        elif start > last:
            continue
        elif page.startswith(("<!", "<?"), start):
            section = start < data and page.startswith("<![CDATA[", start)
            at = page.find("]]>", start) + 3 if section else page.find(">", start) + 1
            yield start, at, "", None
        elif m := OPENING.match(page, start + 1):
            whole = ATTRIBUTES.match(page, m.end()) if quoted and not m[1] else None
            quoted = quoted and (whole is not None or bool(m[1]))
            at = whole.end() if whole else page.find(">", m.end()) + 1
            goto = yield start, at, m[2].lower(), None if m[1] else page[m.end() : at - 1]
            if goto is not None:
                at = goto
                yield 0, 0, "", None


def stream_blocks(page: str) -> list[tuple[int, str]]:
    """The page's text blocks in order, each with its kind."""
    stack: list[tuple[str, bool, bool, int, bool, int]] = []  # element; silent, beside, form's number, whether an article, holder's number
    silent = beside = article = headline = 0
    opened: dict[str, int] = {}  # how many of an element are open
    forms: list[int] = []  # the open forms outside of the main text
    around: list[bool] = []  # of each form, whether main text or a headline is marked in it
    holders: list[int] = []  # the open elements that mark the main text
    outer: list[int] = []  # of each, the one around it
    paragraphs: set[int] = set()
    title = ""
    text: list[str] = []
    found: list[tuple[str, bool, int, bool, int, bool]] = []  # block, beside, form, in an article, holder, in an h1

    def flush() -> None:
        if text:
            block = SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if block:
                found.append((block, beside > 0, forms[0] if forms else -1, article > 0, holders[-1] if holders else -1, headline > 0))

    def close(k: int) -> None:
        nonlocal silent, beside, article, headline
        for name, mute, b, form, a, holder in reversed(stack[k:]):
            opened[name] -= 1
            silent -= mute
            beside -= b
            article -= a
            headline -= name == "h1"
            if form >= 0:
                forms.pop()
            if holder >= 0:
                holders.pop()
        del stack[k:]

    def add(piece: str) -> None:
        if stack and stack[-1][0] == "head" and piece.strip():
            close(len(stack) - 1)
        if not silent and piece:
            text.append(piece)

    at, tags = 0, _tags(page)
    for start, end, name, attributes in tags:
        add(page[at:start])
        at = end
        if not name:
            continue
        if attributes is None:
            if name in BLOCKS or name in SILENT:
                flush()
            if opened.get(name):
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                if stack[k][2]:
                    flush()
                close(k)
            continue
        if stack and stack[-1][0] == "head" and name not in HEAD:
            close(len(stack) - 1)
        if name in BLOCKS or name in SILENT:
            flush()
        elif name == "br" and not silent:
            text.append(" ")
        if name in VOID or attributes.endswith("/"):
            continue
        if stack and stack[-1][0] in CLOSES.get(name, ()):
            close(len(stack) - 1)
        mute, within = name in SILENT, article > 0 or bool(holders)
        b, marks = _part(name, attributes, within)
        if b:
            flush()
        form = holder = -1
        plain = not beside and not b and not silent and not mute
        if name == "form" and not within:
            form = len(around)
            around.append(False)
            forms.append(form)
        elif name == "form":
            b = True
        if plain and (name in ("article", "h1") or marks) and forms:
            around[forms[0]] = True
        if name == "p" and forms:
            paragraphs.add(forms[0])
        if marks and plain:
            holder = len(outer)
            outer.append(holders[-1] if holders else -1)
            holders.append(holder)
        stack.append((name, mute, b, form, name == "article" and plain, holder))
        opened[name] = opened.get(name, 0) + 1
        silent += mute
        beside += b
        article += name == "article" and plain
        headline += name == "h1"
        if name in RAW_TEXT:
            m = RAW_TEXT[name].search(page, end)
            stop = m.start() if m else len(page)
            if name == "title" and not title:
                title = SPACE.sub(" ", html.unescape(page[end:stop])).strip()
            tags.send(stop)
            at = stop
    add(page[at:])
    flush()
    if all(b or (f >= 0 and not around[f]) for _, b, f, *_ in found):
        around = [a or k in paragraphs for k, a in enumerate(around)]
    off = [b or (f >= 0 and not around[f]) for _, b, f, *_ in found]
    wraps: set[int] = set()  # what holds an article doesn't mark the main text itself
    for (_, _, _, a, h, _), gone in zip(found, off, strict=True):
        while a and not gone and h >= 0 and h not in wraps:
            wraps.add(h)
            h = outer[h]
    inside = [not gone and (a or (h >= 0 and h not in wraps)) for (_, _, _, a, h, _), gone in zip(found, off, strict=True)]
    marked = any(inside)
    out = []
    for (block, _, _, _, _, h1), gone, i in zip(found, off, inside, strict=True):
        kind = BESIDE if gone or marked > i else INSIDE if i else PLAIN
        if kind != BESIDE and h1 and (i or title.startswith(block)):
            kind = HEADLINE
        out.append((kind, block))
    return out


def blocks(page: str) -> tuple[bool, list[str]]:
    """Whether the page marks its main text, and the blocks that structure alone would choose."""
    found = stream_blocks(page)
    return any(k == INSIDE for k, _ in found), [b for k, b in found if k != BESIDE]


def _number(text: str) -> int:
    """A signed 64-bit hash."""
    return int(np.uint64(xxhash.xxh64_intdigest(text)).view(np.int64))


#: What a slice of a bundle holds.
PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.int64()), ("stream", pa.int64()), ("kinds", pa.list_(pa.int8())), ("blocks", pa.list_(pa.string()))])
HOST = re.compile(r"[^/]*//([^/?#:]*)")


def _packed(path: str) -> Callable:
    """Pages to slices in one bundle file a task; rows: slice, file, at, size and the pages' hosts and streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("html text", lambda: None)
        fs, root = place(path)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}.blocks"
        options, at, k = pa.ipc.IpcWriteOptions(compression="zstd"), 0, 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in text_slices(batches, "text"):
                found = [stream_blocks(t or "") for t in batch.column(1).to_pylist()]
                urls = batch.column(2).to_pylist()
                host = [_number(m[1].lower() if (m := HOST.match(u or "")) else "") for u in urls]
                stream = [_number(" ".join(b for _, b in f)) for f in found]
                rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(host, pa.int64()), pa.array(stream, pa.int64()), pa.array([[h for h, _ in f] for f in found], pa.list_(pa.int8())), pa.array([[b for _, b in f] for f in found], pa.list_(pa.string()))], schema=PAGE)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, PAGE, options=options) as writer:
                    writer.write_batch(rows)
                data = sink.getvalue()
                out.write(data)
                pairs = sorted(set(zip(host, stream, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array([context.partitionId() << 24 | k], pa.int64()), pa.array([name]), pa.array([at], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([[{"host": h, "stream": x} for h, x in pairs]], pa.list_(pa.struct([("host", pa.int64()), ("stream", pa.int64())])))], ["slice", "file", "at", "size", "streams"])
                at += len(data)
                k += 1

    return run


class Streams:
    """The token streams of a slice: tokens (hashes), first (of each page), and the anchors of their strings."""

    def __init__(self, rows: pa.RecordBatch):
        joined = pa.array(["\n".join(b) for b in rows.column("blocks").to_pylist()], pa.string())
        data, offsets = buffers(joined)
        words = Words(data, offsets)
        self.tokens = span_hash(prefix_hash(data), words.start, words.end)
        self.first = words.first
        self.host, self.stream = rows.column("host").to_numpy(), rows.column("stream").to_numpy()
        self.at = self.low = self.high = self.page = np.zeros(0, np.int64)
        self.hash = np.zeros(0, U)
        n = len(self.tokens) - GRAM + 1
        last = words.first[1:][words.text]
        starts = np.flatnonzero(np.arange(len(self.tokens)) + RUN <= last)
        if not len(starts):
            return
        grams = mix(self.host.view(U))[words.text[:n]]
        for k in range(GRAM):
            grams = mix(grams ^ self.tokens[k : k + n])
        least = sliding_least((grams & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U), W)
        anchor = (least[starts] & U(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        begin = np.flatnonzero(new)
        self.at, self.low, self.high = anchor[begin], starts[begin], starts[np.append(begin[1:], len(starts)) - 1]
        self.hash, self.page = grams[self.at], words.text[self.low]


def _read(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(slice, its pages, further columns) of each manifest row."""
    fs, root = place(path)
    for batch in batches:
        for slice_, name, at, size, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with fs.open_input_file(f"{root}/{name}") as file:
                data = file.read_at(size, at)
            with pa.ipc.open_stream(data) as reader:
                yield slice_, reader.read_next_batch(), more


def _send(path: str, ranges: int) -> Callable:
    """Each slice's distinct anchors (the low half of their hashes) with how many pages' streams have them, by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slice_, rows, _ in _read(path, batches):
            s = Streams(rows)
            hashes, counts = np.unique(s.hash, return_counts=True)
            if not len(hashes):  # no page of the slice has a string
                continue
            used, begin = np.unique(range_of(hashes, ranges), return_index=True)
            ends = np.append(begin[1:], len(hashes))
            low, times = (hashes & U(0xFFFFFFFF)).astype(np.uint32), np.minimum(counts, 255).astype(np.uint8)
            columns = [pa.array(used.astype(np.int32)), pa.array([slice_] * len(used), pa.int64()), pa.array([low[a:b].tobytes() for a, b in zip(begin, ends, strict=True)], pa.binary()), pa.array([times[a:b].tobytes() for a, b in zip(begin, ends, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["range", "slice", "keys", "times"])

    return run


def _meet(rows: pa.Table) -> pa.Table:
    """Which anchors of each slice occur PAGES times or more in all."""
    keys = [np.frombuffer(x, np.uint32) for x in rows.column("keys").to_pylist()]
    times = np.frombuffer(b"".join(rows.column("times").to_pylist()), np.uint8)
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    often = (np.bincount(inverse, weights=times) >= PAGES)[inverse]
    masks = [np.packbits(x).tobytes() for x in np.split(often, np.cumsum([len(k) for k in keys])[:-1])]
    return pa.table({"range": rows.column("range"), "slice": rows.column("slice"), "mask": pa.array(masks, pa.binary())})


SUFFIX = "host long, lead binary, stream long, slice long, page int, low int, around binary"


def _emit(path: str, ranges: int) -> Callable:
    """The suffixes at frequent anchors: leading tokens, page, first string's place in it, and the tokens of the strings around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slice_, rows, (masks,) in _read(path, batches):
            s = Streams(rows)
            hashes, inverse = np.unique(s.hash, return_inverse=True)
            sizes = np.bincount(range_of(hashes, ranges), minlength=1)
            often = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=sizes[m["range"]]) for m in sorted(masks, key=lambda m: m["range"]))])
            tokens = (s.tokens >> U(32)).astype(">u4")
            chosen = np.flatnonzero(often[inverse])
            for k in range(0, len(chosen), 8192):
                pick = chosen[k : k + 8192]
                low, high, at, page = s.low[pick], s.high[pick], s.at[pick], s.page[pick]
                around = [tokens[a : b + RUN].tobytes() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                lead = [tokens[a : a + GRAM].tobytes() for a in at.tolist()]
                columns = [pa.array(s.host[page]), pa.array(lead, pa.binary()), pa.array(s.stream[page]), pa.array(np.full(len(pick), slice_)), pa.array(page.astype(np.int32)), pa.array((low - s.first[page]).astype(np.int32)), pa.array(around, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["host", "lead", "stream", "slice", "page", "low", "around"])

    return run


FOUND = "host long, key long, stream long, slice long, page int, start int, pages int"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings that PAGES distinct pages or more share within a partition; those of a group at its ends with a null for the pages."""
    held: list[pa.RecordBatch] = []
    ends: set[tuple] = set()  # groups that may go on in another partition, or that were taken in pieces

    def names(part: pa.RecordBatch) -> list[tuple]:
        return list(zip(part.column("host").to_pylist(), part.column("lead").to_pylist(), strict=True))

    def work(part: pa.RecordBatch, group: list[tuple]) -> pa.RecordBatch:
        sizes = np.diff(np.concatenate([[0], np.cumsum([len(x) // 4 for x in part.column("around").to_pylist()])])).astype(np.int64)
        tokens = np.frombuffer(b"".join(part.column("around").to_pylist()), ">u4").astype(U)
        strings = sizes - RUN + 1
        row = np.repeat(np.arange(len(sizes)), strings)
        within = np.arange(len(row)) - np.repeat(np.cumsum(strings) - strings, strings)
        start = np.repeat(np.cumsum(sizes) - sizes, strings) + within
        hashes = mix(part.column("host").to_numpy().view(U))[row]
        for k in range(RUN):
            hashes = mix(hashes ^ tokens[start + k])
        stream = part.column("stream").to_numpy()[row]
        unique, number = np.unique(hashes, return_inverse=True)
        pair = np.unique(np.stack([number, np.unique(stream, return_inverse=True)[1]]), axis=1)
        pages = np.bincount(pair[0], minlength=len(unique))[number]
        at_end = np.array([g in ends for g in group])[row]
        e = np.flatnonzero(at_end | (pages >= PAGES))
        take = lambda name: part.column(name).take(pa.array(row[e]))
        columns = [take("host"), pa.array(hashes[e].view(np.int64)), take("stream"), take("slice"), take("page"), pa.array((part.column("low").to_numpy()[row] + within)[e].astype(np.int32)), pa.array(pages[e].astype(np.int32), mask=at_end[e])]
        return pa.RecordBatch.from_arrays(columns, ["host", "key", "stream", "slice", "page", "start", "pages"])

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        merged = pa.Table.from_batches(held).combine_chunks().to_batches()
        held.clear()
        if not merged:
            return
        part = merged[0]
        group = names(part)
        if not ends:
            ends.add(group[0])
        cut = len(group)
        if last:
            ends.add(group[-1])
        else:
            while cut and group[cut - 1] == group[-1]:
                cut -= 1
            if not cut:  # one group fills it: its pieces are compared like those of several partitions
                ends.add(group[0])
                cut = len(group)
        yield work(part.slice(0, cut), group[:cut])
        if cut < len(group):
            held.append(part.slice(cut))

    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 50_000:
            yield from flush(False)
            rows = sum(b.num_rows for b in held)
            if rows >= 50_000:
                rows = 0
    if held:
        yield from flush(True)


def main_text(kinds: list[int], found: list[str], shared: np.ndarray, wide: np.ndarray) -> str:
    """What stays of a page's blocks; shared and wide: for each token, whether PAGES and whether most pages have it."""
    kept, at = [], 0
    for k, b in zip(kinds, found, strict=True):
        end = at + b.count(" ") + 1
        gone = (wide if k == INSIDE else shared)[at:end]
        at = end
        if k == HEADLINE or (k != BESIDE and not gone.any()):
            kept.append(b)
        elif k != BESIDE and not gone.all():
            kept.append(" ".join(t for t, g in zip(b.split(" "), gone.tolist(), strict=True) if not g))
    return "\n".join(kept)


def _finish(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, (runs,) in _read(path, batches):
            of: dict[int, list] = {}
            for r in runs or []:
                of.setdefault(r["page"], []).append((r["start"], r["wide"]))
            out = []
            for i, (kinds, found) in enumerate(zip(rows.column("kinds").to_pylist(), rows.column("blocks").to_pylist(), strict=True)):
                n = sum(b.count(" ") + 1 for b in found)
                shared, wide = np.zeros(n, bool), np.zeros(n, bool)
                for start, w in of.get(i, ()):
                    shared[start : start + RUN] = True
                    if w:
                        wide[start : start + RUN] = True
                out.append(main_text(kinds, found, shared, wide))
            yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return run


def shared_strings(manifest: DataFrame, path: str) -> DataFrame:
    """slice, page, start, wide: the strings of RUN tokens that PAGES distinct pages of a host share; wide: most of the host's pages, and MANY."""
    slices = manifest.select("slice", "file", "at", "size")
    size = manifest.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    total, parts = 4 * size["b"], max(1, -(-size["n"] // 4))
    ranges = max(1, total // (35 * RANGE_KEYS))
    sent = slices.repartition(parts).mapInArrow(_send(path, ranges), "range int, slice long, keys binary, times binary")
    masks = sent.groupBy("range").applyInArrow(_meet, "range int, slice long, mask binary").groupBy("slice").agg(F.collect_list(F.struct("range", "mask")).alias("masks"))
    chosen = slices.join(masks, "slice").select("slice", "file", "at", "size", "masks")
    around = written(chosen.repartition(parts).mapInArrow(_emit(path, ranges), SUFFIX), "html-suffixes")
    order = ["host", "lead", "stream", "slice", "page", "low"]
    buckets = max(8, -(-around.count() * 100 // SORT_BYTES))
    found = written(around.repartitionByRange(buckets, *order).sortWithinPartitions(*order).mapInArrow(_compare, FOUND), "html-found")
    edge = found.where("pages is null").drop("pages")
    counted = edge.select("key", "stream").distinct().groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("pages")).where(F.col("pages") >= PAGES)
    crossing = edge.join(checked(written(counted, "html-edges")), "key")
    hosts = manifest.select(F.explode("streams").alias("s")).select("s.host", "s.stream").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    every = found.where("pages is not null").select("host", "slice", "page", "start", "pages").unionByName(crossing.select("host", "slice", "page", "start", "pages"))
    return every.join(checked(written(hosts, "html-hosts")), "host").select("slice", "page", "start", ((HALF * F.col("pages") > F.col("all")) & (F.col("pages") >= MANY)).alias("wide"))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    path = scratch(pages.sparkSession, "html")
    view = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("text"), F.col("url").cast("string").alias("url"))
    manifest = written(view.mapInArrow(_packed(path), "slice long, file string, at long, size long, streams array<struct<host:long,stream:long>>"), "html-slices")
    runs = shared_strings(manifest, path).groupBy("slice").agg(F.collect_list(F.struct("page", "start", "wide")).alias("runs"))
    done = manifest.select("slice", "file", "at", "size").join(runs, "slice", "left").select("slice", "file", "at", "size", "runs")
    return done.mapInArrow(_finish(path), "page_id long, url string, text string")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
