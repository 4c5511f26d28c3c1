"""Main text of web pages by nearest-URL page differencing.

1. Each page is cut into text lines (blocks), each with its place in the markup.
2. Pages stand in the order of host, path, id and content. A page is paired with
   whichever of its two neighbours on the same host shares the longer path prefix
   (the earlier of equals) and isn't a copy: ``COPY_SHARE`` of the longer page's
   characters in common, or more. If both are copies there is nothing to difference.
3. The pair's lines are aligned by a longest common subsequence. The lines in it,
   the parts of the template that repeat, are deleted.
4. Markup breaks what is contradictory. Lines of an ``article`` are never deleted:
   pages quote each other, and a quoted line is text of both. Lines of navigation,
   headers, footers, asides, scripts, adverts, notices and comments are deleted also
   where no neighbour shares them: adverts differ from page to page. All other lines
   (of ``main`` outside an article, of no such element, of a form around the page)
   rest on differencing alone. A page with an article or ``main`` consists of these,
   one without them of the lines of no special place.

An article below a wrapper that is named like a template (``class="with sidebar"``)
or below a form counts where the page has no other; one among comments, related
links or adverts never does.

The alignment runs on bit vectors, a row a line. Rows are kept at every
root-of-n-th line and the others computed again while walking back, so memory stays
bounded and the result is one and the same for pages of any size.

The order is cut into stretches by bounds from a bounded sample of the addresses, and
dealt by stretch, so a host with a third of all pages is spread. The first and last
page of a stretch are also sent to the neighbouring one, so the result doesn't depend
on where the cuts lie. A few pages at most are held at a time.

Defined cases: a null page has the empty text; a null URL counts as host ''; a
host with a single page has nothing to difference; repeated rows (equal id, URL and
page) are one neighbour and get equal results, one each; an empty table gives no
rows; other columns are ignored; markup that is cut off or not closed ends with the
page. Parsing takes time in proportion to the page.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import url_filter

#: Places of lines: in an article; in main but no article; in an article below a loosely named wrapper or a form; in none; in a form; template.
ARTICLE, MAIN, LOOSE, PLAIN, FORM, CHROME = "a", "m", "l", "p", "f", "c"
#: A neighbour that shares this part of the longer page's characters, or more, is a copy.
COPY_SHARE = 0.9
#: Stretches of the order: about this many pages each while there are at most so many, then longer ones.
STRETCH_PAGES, STRETCHES = 500, 50_000
#: Sampled addresses for each stretch, and what is taken of each; so what comes to the driver is bounded by parameters.
SAMPLE_PER_STRETCH, BOUND_CHARS = 10, 256

#: Elements that start and end a line; that never close; whose content is no text; that are template.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
TEMPLATE = frozenset("nav header footer aside script style noscript template iframe button select option textarea input label fieldset menu dialog head title svg canvas object audio video search".split())
TEMPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Parts of class names and ids. Firm ones hold no article of the page; loose ones may wrap it; neutral ones say nothing beside them.
FIRM_NAMES = frozenset("ad ads adv advert adverts advertisement advertisements advertising adbox comment comments disqus discussion promo promos promoted related replies reply respond responses share sharing social sponsor sponsored".split())
LOOSE_NAMES = frozenset("banner breadcrumb breadcrumbs consent cookie cookies footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup sidebar sidebars signup skip subscribe subscription toolbar topbar widget widgets".split())
NEUTRAL_NAMES = frozenset("area bar block bottom box button buttons container global inner item items left link links list main outer page post posts primary right secondary section site text top wrap wrapper".split())
#: Elements that an opening tag of the given kind closes by itself, as browsers do.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"[>=]")
_WHITE = re.compile(r"\s*")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W_a-zA-Z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}


def _named(value: str, in_article: bool) -> str | None:
    """FIRM or LOOSE of a class or id; its tokens count whole: each part of one is a template name or neutral."""
    kind = None
    for token in value.split():
        parts = [p.lower() for p in _PARTS.findall(token)]
        if all(p in FIRM_NAMES or p in LOOSE_NAMES or p in NEUTRAL_NAMES for p in parts):
            if any(p in FIRM_NAMES for p in parts):
                return "firm"
            if any(p in LOOSE_NAMES and not (in_article and p == "header") for p in parts):
                kind = "loose"
    return kind


def _kind(tag: str, attributes: str, in_article: bool) -> str | None:
    """What an element says of its lines: article, main, form, firm or loose template; None: nothing."""
    if tag in TEMPLATE and not (in_article and tag == "header"):
        return "firm"
    kind = tag if tag in ("article", "main", "form") else None
    if not attributes:
        return kind
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in TEMPLATE_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "firm"
        if name == "role" and value.lower() in ("article", "main"):
            kind = value.lower()
        elif name in ("class", "id") and tag not in ("html", "body", "main"):
            named = _named(value, in_article)
            if named == "firm" or named and kind not in ("article", "main"):
                kind = named
        if kind == "firm":
            return kind
    return kind


def _below(place: str, kind: str | None) -> str:
    """The place of the lines of an element of a kind, below another place. CHROME with '!' is firm."""
    if kind is None or place == "!" or kind == "form" and place in (ARTICLE, MAIN, LOOSE):
        return "!" if kind == "form" else place
    if kind == "firm":
        return "!"
    if kind in ("article", "main"):
        if place in (CHROME, FORM, LOOSE):
            return LOOSE
        return ARTICLE if kind == "article" or place == ARTICLE else MAIN
    if kind == "loose":
        return "!" if place in (ARTICLE, MAIN, LOOSE) else CHROME
    return FORM if place == PLAIN else place


def lines(page: str) -> list[tuple[str, str]]:
    """(place, text) of each text line of a page, in order."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    opened: dict[str, int] = {}
    unclosed: set[str] = set()  # quotes that don't occur any more
    place, here, at, end = PLAIN, [], 0, len(page)

    def close() -> None:
        if here:
            text = " ".join(entities.unescape("".join(here)).split())
            if text:
                out.append((CHROME if place == "!" else place, text))
            here.clear()

    def pop() -> str:
        nonlocal place
        tag, before = stack.pop()
        opened[tag] -= 1
        if before != place:
            close()
            place = before
        return tag

    def tag_end(i: int) -> int:
        """Place of the '>' that ends a tag; a quote counts only where a value begins."""
        while m := _STOP.search(page, i):
            i = m.start()
            if page[i] == ">":
                return i
            i = _WHITE.match(page, i + 1).end()
            q = page[i : i + 1]
            if q in ("'", '"') and q not in unclosed:
                stop = page.find(q, i + 1)
                if stop < 0:
                    unclosed.add(q)
                i = max(stop, i) + 1
        return end

    while at < end:
        start = page.find("<", at)
        if start < 0:
            here.append(page[at:])
            break
        if start > at:
            here.append(page[at:start])
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        closing = page.startswith("/", start + 1)
        name = _NAME.match(page, start + 1 + closing)
        if name is None:
            if closing or page[start + 1 : start + 2] in ("!", "?"):
                stop = page.find(">", start)
                at = stop + 1 if stop >= 0 else end
            else:
                here.append("<")
                at = start + 1
            continue
        tag, stop = name.group().lower(), tag_end(name.end())
        attributes, at = page[name.end() : stop], stop + 1
        if closing:
            if tag in BLOCKS:
                close()
            if opened.get(tag):
                while pop() != tag:
                    pass
            continue
        if tag == "br":
            here.append(" ")
            continue
        if tag in BLOCKS:
            close()
            if stack and stack[-1][0] == "p":
                pop()
        while stack and stack[-1][0] in CLOSES.get(tag, ()):
            pop()
        if tag in RAW:
            # up to its own closing tag, whatever stands in between
            m = _RAW_END[tag].search(page, at)
            at = tag_end(m.end()) + 1 if m else end
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        now = _below(place, _kind(tag, attributes, place in (ARTICLE, MAIN, LOOSE)))
        if now != place:
            close()
        stack.append((tag, place))
        opened[tag] = opened.get(tag, 0) + 1
        place = now
    close()
    return out


def _rows(a: list[int], where: dict[int, int], full: int, v: int) -> Iterator[int]:
    """Bit vectors of the LCS table, a row for each of a, after the row v: a 0 bit at j where the length rises."""
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
        yield v


def common(a: list[int], b: list[int], step: int | None = None) -> list[tuple[int, int]]:
    """A longest common subsequence of a and b, as pairs of places; ``step``, the distance of the rows that are kept, doesn't change it."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    # lines that only one side has can't be in it
    at_a = [i for i in range(head, len(a) - tail) if a[i] in both]
    at_b = [j for j in range(head, len(b) - tail) if b[j] in both]
    mid: list[tuple[int, int]] = []
    if both:
        x = [a[i] for i in at_a]
        where: dict[int, int] = {}
        for k, j in enumerate(at_b):
            where[b[j]] = where.get(b[j], 0) | 1 << k
        full = (1 << len(at_b)) - 1
        step = step or isqrt(len(x)) + 1
        kept = [full]
        for k, v in enumerate(_rows(x, where, full, full), 1):
            if k % step == 0:
                kept.append(v)
        i, j, base, rows = len(x) - 1, len(at_b) - 1, len(x), []
        while i >= 0 and j >= 0:
            if i < base:
                base = i // step * step
                rows = [kept[base // step], *_rows(x[base : base + step], where, full, kept[base // step])]
            # rows[k + 1] is the row of line base + k, rows[0] the one before
            if rows[i - base + 1] >> j & 1:
                j -= 1
            elif not rows[i - base] >> j & 1:
                i -= 1
            else:
                mid.append((at_a[i], at_b[j]))
                i, j = i - 1, j - 1
        mid.reverse()
    return [(i, i) for i in range(head)] + mid + [(len(a) - t, len(b) - t) for t in range(tail, 0, -1)]


def shared(own: list[tuple[str, str]], others: list[list[tuple[str, str]]]) -> set[int]:
    """Which lines of a page the first of the other pages that is no copy of it shares."""
    for other in others:
        number: dict[str, int] = {}
        a, b = ([number.setdefault(t, len(number)) for _, t in page] for page in (own, other))
        found = {i for i, _ in common(a, b)}
        longer = max(sum(len(t) for _, t in page) for page in (own, other))
        if sum(len(own[i][1]) for i in found) < COPY_SHARE * longer:
            return found
    return set()


def main_lines(own: list[tuple[str, str]], others: list[list[tuple[str, str]]]) -> tuple[list[str], list[int]]:
    """The page's main text by lines, given the lines of its neighbours, nearest first; and how many lines
    fell as shared, fell by markup alone, were left by differencing, and stayed as an article's though shared."""
    there, gone = {p for p, _ in own}, shared(own, others)
    fixed = ARTICLE if there & {ARTICLE, MAIN} else LOOSE
    open_ = MAIN if there & {ARTICLE, MAIN} else LOOSE if LOOSE in there else PLAIN if PLAIN in there else FORM
    kept, counts = [], [0, 0, 0, 0]
    for i, (p, t) in enumerate(own):
        if p == fixed or p == open_ and i not in gone:
            kept.append(t)
            counts[2] += p != fixed
            counts[3] += p == fixed and i in gone
        else:
            counts[0 if i in gone else 1] += 1
    return kept, counts


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


_KEY = ["host", "path", "id", "h"]
_KEY_TYPE = "host string, path string, id bigint, h bigint"


def _keys(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(b.column(c).to_pylist() for c in _KEY))


def _bounds(keys: DataFrame) -> list[tuple]:
    """Keys that cut the order into stretches, from a bounded sample: any keys will do, since the cuts don't change the result."""
    rows = keys.count()
    n = max(1, min(STRETCHES, rows // STRETCH_PAGES))
    share = min(1.0, SAMPLE_PER_STRETCH * n / max(1, rows))
    some = keys if share == 1 else keys.filter(F.xxhash64(*_KEY) / F.lit(2.0**64) + 0.5 < share)
    cut = some.select(F.substring("host", 1, BOUND_CHARS), F.substring("path", 1, BOUND_CHARS), "id", "h")
    sample = sorted(tuple(r) for r in cut.collect())
    return sorted({sample[len(sample) * k // n] for k in range(1, n)}) if sample else []


def _visits(keys: DataFrame, bounds: list[tuple]) -> dict[int, list[int]]:
    """Hash of the first and last key of each stretch -> the stretches that these also go to."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple]] = {}
        for b in batches:
            for key in _keys(b):
                two = found.setdefault(bisect_right(bounds, key), [key, key])
                two[0], two[1] = min(two[0], key), max(two[1], key)
        flat = [(at, *key) for at, two in found.items() for key in two]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["at", *_KEY])

    key = F.struct(*_KEY)
    both = keys.mapInArrow(ends, f"at bigint, {_KEY_TYPE}").groupBy("at").agg(F.min(key).alias("a"), F.max(key).alias("b"))
    # a row a stretch
    edges = sorted(tuple(r) for r in both.select("at", *(F.xxhash64(*(f"{k}.{c}" for c in _KEY)) for k in "ab")).collect())
    out: dict[int, list[int]] = {}
    for (left, _, last), (right, first, _) in zip(edges, edges[1:]):
        out.setdefault(last, []).append(right)
        out.setdefault(first, []).append(left)
    return out


def extract(pages: DataFrame, bounds: Callable[[DataFrame], list[tuple]] = _bounds) -> DataFrame:
    """page_id, url, text, n_chars (code points), and of its lines n_shared (deleted as the nearest page's too), n_template
    (deleted by markup alone), n_left (left by differencing), n_restored (shared, but an article's): a row for each row of
    ``pages``. The lines are shuffled once, compressed."""
    spark = pages.sparkSession
    host, path = url_filter.parts("url")
    cut = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).withColumns({"host": host, "path": path, "id": F.coalesce("page_id", F.lit(-(1 << 63))), "h": F.xxhash64("html", "url")})
    keys = cut.select(*_KEY)
    cuts = bounds(keys)
    sent = spark.sparkContext.broadcast((cuts, _visits(keys, cuts) if cuts else {}))  # a bound and two hashes a stretch

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, (cuts, visits) = zstandard.ZstdCompressor(level=3), sent.value
        for b in batches:
            packed = [pack.compress("\n".join(p + t for p, t in lines(h.as_py() or "")).encode("utf-8", "surrogatepass")) for h in b.column("html")]
            at, row, own = [], [], []
            for i, (key, hashed) in enumerate(zip(_keys(b), b.column("key_hash").to_pylist())):
                where = [bisect_right(cuts, key), *visits.get(hashed, ())]
                at, row, own = at + where, row + [i] * len(where), own + [True] + [False] * (len(where) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array(own), *(b.column(c).take(pa.array(row, pa.int64())) for c in ("page_id", "url", *_KEY)), pa.array([packed[i] for i in row], pa.binary())],
                ["at", "own", "page_id", "url", *_KEY, "packed"],
            )

    parsed = cut.withColumn("key_hash", F.xxhash64(*_KEY)).mapInArrow(parse, f"at bigint, own boolean, page_id bigint, url string, {_KEY_TYPE}, packed binary")
    ordered = parsed.repartition("at").sortWithinPartitions("at", *_KEY)

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()

        def pages_() -> Iterator[list]:
            """Pages of equal keys together: stretch, host, path, id, h, page_id, url, lines, how many are to be answered."""
            held: list | None = None
            for b in batches:
                for at, own, key, page, url, packed in zip(b.column("at").to_pylist(), b.column("own").to_pylist(), _keys(b), b.column("page_id"), b.column("url"), b.column("packed")):
                    if held is not None and held[:5] == [at, *key]:
                        held[8] += own
                        continue
                    if held is not None:
                        yield held
                    text = unpack.decompress(packed.as_py()).decode("utf-8", "surrogatepass") if packed.as_py() else ""
                    held = [at, *key, page.as_py(), url.as_py(), [(x[0], x[1:]) for x in text.split("\n") if x], int(own)]
            if held is not None:
                yield held

        def done(before: list | None, own: list, after: list | None) -> Iterator[tuple]:
            if own[8]:
                near = [n for n in (before, after) if n is not None and n[:2] == own[:2]]
                near.sort(key=lambda n: -_prefix(n[2], own[2]))
                kept, counts = main_lines(own[7], [n[7] for n in near])
                text = "\n".join(kept)
                for _ in range(own[8]):
                    yield own[5], own[6], text, len(text), *counts

        def results() -> Iterator[tuple]:
            before = own = None
            for after in pages_():
                if own is not None:
                    yield from done(before, own, after)
                before, own = own, after
            if own is not None:
                yield from done(before, own, None)

        held: list[tuple] = []
        size = 0
        for r in results():
            held.append(r)
            size += len(r[2])
            if size > 1 << 20:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    return ordered.mapInArrow(difference, ", ".join(f"{c} {t}" for c, t in _RESULT))


_RESULT = [("page_id", "bigint"), ("url", "string"), ("text", "string"), *((c, "bigint") for c in ("n_chars", "n_shared", "n_template", "n_left", "n_restored"))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string() if t == "string" else pa.int64() for _, t in _RESULT]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c for c, _ in _RESULT])
