"""Main text of web pages by differencing against the page with the nearest URL on the same host.

A page becomes lines (text blocks) with a mark for their place. Within each host, pages are ordered by the segments of
their URL path; of the nearest pages with other content on both sides the one with the longer common path is the
partner, however many copies stand between. Both pages' lines
are aligned by their longest common subsequence, menus, adverts and footers too, and shared lines are deleted: they are
the host's template. Markup guards the article: where a page has one, only its lines count, and a shared line in it is
deleted only if the page has it outside as well (in its menu, say), so that lines and passages which articles share
stay. A page without article and partner keeps what its markup does not name as menu, header, footer, sidebar,
notice, advert, form or comments.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orfloom.operators.ordering import ordered_prefix, with_neighbours
from orfloom.operators.skew import hot_split_join
from orfloom.session import cut_lineage

# fixed values: element names and words of class, id and role
SKIPPED = frozenset("script style noscript template nav header footer aside form svg iframe button select textarea head dialog menu object canvas".split())
HARD = frozenset("script style noscript template svg iframe textarea head object canvas".split())  # no text of the page, whatever they hold
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol "
    "p pre section summary table tbody td tfoot th thead tr ul br".split()
)
JUNK = re.compile(
    r"(?i)(^|[-_ ])(ad|ads|advert|advertisement|adbox|banner|sponsor|sponsored|promo|sidebar|nav|navbar|menu|breadcrumb|breadcrumbs|"
    r"footer|header|masthead|cookie|cookies|consent|notice|popup|modal|newsletter|subscribe|share|social|comment|comments|disqus|"
    r"related|widget|toolbar|pagination|pager|search|login|signup)([-_ ]|$)"
)
CLOSES_P = BLOCK - {"br", "body", "html"}
WHITE = re.compile(r"\s+")


INSIDE, SKIPPED_LINE, FREED = 1, 2, 4  # bits of a block's place


class Blocks(HTMLParser):
    """(text, place) of every block in page order; text of skipped elements stands in blocks of its own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int]] = []
        self.text: list[str] = []
        self.beside: list[str] = []  # text of skipped elements
        self.stack: list[tuple[str, int, bool]] = []  # name, place, no text at all

    def _state(self) -> tuple[int, bool]:
        return self.stack[-1][1:] if self.stack else (0, False)

    def _flush(self) -> None:
        place = self._state()[0] & ~SKIPPED_LINE
        for texts, mark in ((self.text, 0), (self.beside, SKIPPED_LINE)):
            line = WHITE.sub(" ", "".join(texts)).strip()
            texts.clear()
            if line:
                self.blocks.append((line, place | mark))

    def handle_starttag(self, tag, attrs):
        place, hard = self._state()
        if tag in CLOSES_P and any(name == "p" for name, *_ in self.stack):
            self.handle_endtag("p")
            place, hard = self._state()
        if tag in BLOCK or tag in SKIPPED:
            self._flush()
        if tag in VOID:
            return
        named = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        article = bool(place & INSIDE)
        main = tag == "main" or any(k == "role" and v == "main" for k, v in attrs)
        own = tag in ("article", "main") or (not article and main)
        # a header inside the article holds its own headline
        junk = (tag in SKIPPED and not (tag == "header" and article)) or bool(named and not own and tag not in ("body", "html") and JUNK.search(named))
        if own and not article and place & SKIPPED_LINE and (main or not JUNK.search(named)):
            # an article ends the skip of what stands around it, such as a form around the page
            place = 0 if main else FREED
        self.stack.append((tag, place | INSIDE * own | SKIPPED_LINE * junk, hard or tag in HARD))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                if tag in BLOCK or tag in SKIPPED:
                    self._flush()
                del self.stack[k:]
                return

    def handle_data(self, data):
        place, hard = self._state()
        if not hard:
            (self.beside if place & SKIPPED_LINE else self.text).append(data)


def page_blocks(source: str | None) -> list[tuple[str, int]]:
    """(text, place) of every block of the page, those under skipped elements too; place has INSIDE and SKIPPED_LINE.

    An article under a skipped element counts only if the page has no other, else it is one more teaser.
    """
    parser = Blocks()
    try:
        parser.feed(source or "")
        parser.close()
    except (AssertionError, ValueError):  # a malformed declaration: take what is left as text
        rest = re.sub(r"(?s)<[^>]*>", "\n", parser.rawdata)
        parser.rawdata = ""
        parser.handle_data(html.unescape(rest))
    parser._flush()
    other = any(place & (INSIDE | SKIPPED_LINE | FREED) == INSIDE for _, place in parser.blocks)
    return [
        (line, (SKIPPED_LINE if other else place & ~FREED) if place & FREED else place) for line, place in parser.blocks
    ]


def page_lines(source: str | None) -> list[tuple[str, bool]]:
    """(text, inside the article) of the blocks that markup alone leaves."""
    return [(line, bool(place & INSIDE)) for line, place in page_blocks(source) if not place & SKIPPED_LINE]


def line_marks(lines: list[str]) -> list[int]:
    """A 64-bit hash per line: stands for the line where pages are compared, so that only hashes travel to a partner."""
    return np.array([xxhash.xxh3_64_intdigest(line) for line in lines], np.uint64).view(np.int64).tolist()


def shared_lines(own: list, other: list) -> list[bool]:
    """Which lines of ``own`` lie on the longest common subsequence with ``other`` (bit-parallel rows)."""
    n, m = len(own), len(other)
    shared = [False] * n
    a = 0
    while a < min(n, m) and own[a] == other[a]:
        shared[a] = True
        a += 1
    z = 0
    while z < min(n, m) - a and own[n - 1 - z] == other[m - 1 - z]:
        shared[n - 1 - z] = True
        z += 1
    middle = other[a : m - z]
    places: dict[str, int] = {}
    for k, line in enumerate(middle):
        places[line] = places.get(line, 0) | (1 << k)
    kept = [i for i in range(a, n - z) if own[i] in places]
    if not kept:
        return shared
    full = (1 << len(middle)) - 1
    v, rows = full, []
    for i in kept:  # a zero bit of v at k: the subsequence grows at line k
        u = v & places[own[i]]
        rows.append(v)
        v = ((v + u) | (v - u)) & full
    k = len(middle)
    for r in range(len(kept) - 1, -1, -1):
        before = rows[r]
        low = (1 << k) - 1
        after = v
        # length with and without this line, over the first k lines of the other page
        if k and (~after & low).bit_count() > (~before & low).bit_count():
            shared[kept[r]] = True
            # the match is the last line that ends a subsequence of this length
            k = (~after & low).bit_length() - 1
        v = before
    return shared


def candidates(places: list[int]) -> list[int]:
    """Numbers of the blocks that can be main text, whatever the partner: the article's, else those that are not skipped, else all."""
    inside = [k for k, place in enumerate(places) if place & (INSIDE | SKIPPED_LINE) == INSIDE]
    plain = [k for k, place in enumerate(places) if not place & SKIPPED_LINE]
    return inside or plain or list(range(len(places)))


def kept(places: list[int], marks: list[int], other: list[int] | None) -> list[bool]:
    """Which of the candidates are the page's main text: those not shared with the partner, whose marks are ``other``.

    Menus, adverts, comments and the like never count, unless a page without article consists of nothing else (as one whose
    whole content stands in a form).
    """
    chosen = candidates(places)
    shared = shared_lines(marks, other) if other else [False] * len(marks)
    if any(places[k] & (INSIDE | SKIPPED_LINE) == INSIDE for k in chosen):
        outside = {mark for mark, place in zip(marks, places, strict=True) if not place & INSIDE}
        return [not (shared[k] and marks[k] in outside) for k in chosen]
    if not other and all(place & SKIPPED_LINE for place in places):
        return [False] * len(chosen)
    return [not shared[k] for k in chosen]


def _mark_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), 256):
            part = batch.slice(a, 256)
            marks = [line_marks([line for line, _ in page_blocks(h)]) for h in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(marks, pa.list_(pa.int64()))], ["url", "marks"])


def _body_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and marks of all blocks, and the candidates' text, compressed for its way to the partner's marks."""
    pack = zstandard.ZstdCompressor()
    for batch in batches:
        for a in range(0, len(batch), 256):
            part = batch.slice(a, 256)
            rows = [page_blocks(h) for h in part.column(2).to_pylist()]
            places = [[place for _, place in r] for r in rows]
            bodies = [
                pack.compress("\n".join(r[k][0] for k in candidates(p)).encode()) for r, p in zip(rows, places, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), pa.array(bodies, pa.binary()), pa.array(places, pa.list_(pa.int8())),
                    pa.array([line_marks([line for line, _ in r]) for r in rows], pa.list_(pa.int64())),
                ],
                ["page_id", "url", "body", "places", "marks"],
            )


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        texts = []
        for body, *seen in zip(*[batch.column(c).to_pylist() for c in (2, 3, 4, 5)], strict=True):
            want = kept(*seen)
            texts.append("\n".join(compress(unpack.decompress(body).decode().split("\n"), want)) if any(want) else "")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def _path(url: Column) -> Column:
    """Segments of the path: in their order no page between two others shares less of the path with either."""
    return F.split(F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", ""), "/")


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _common(x: Column, y: Column) -> Column:
    """Leading path segments that two paths share."""
    n = F.least(F.size(x), F.size(y))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.get(x, i - 1) != F.get(y, i - 1))
    return F.coalesce(F.get(differ, F.lit(0)) - 1, n)


def _entry(url: Column, marks: Column) -> Column:
    """Key of (host, path, content): copies at one path share it. Null without a host."""
    return F.when(_host(url) != "", F.md5(F.concat_ws("\n", _host(url), F.array_join(_path(url), "/"), F.xxhash64(marks).cast("string"))))


def _partners(light: DataFrame) -> DataFrame:
    """(entry, other): marks of the page with other content that shares most of the path, the earlier in path order if both do.

    Copies at one path are one entry. Entries of a host with equal content in a row are a run, and the entries beside
    the run are the nearest with other content for all of it.
    """
    entries = cut_lineage(
        light.groupBy("entry").agg(F.first("url").alias("url"), F.first("marks").alias("marks"))
        .select("entry", _host(F.col("url")).alias("host"), _path(F.col("url")).alias("path"), F.xxhash64("marks").alias("digest"), "marks")
    )
    payload = {"path": F.col("path"), "digest": F.col("digest"), "entry": F.col("entry")}
    near = with_neighbours(entries.drop("marks"), ["host"], ["path", "entry"], payload, 1)
    other = [F.when(F.get("slots", F.lit(k))["digest"] != F.col("digest"), F.get("slots", F.lit(k))) for k in (0, 2)]
    edged = near.select("host", "path", "entry", other[0].alias("before"), other[1].alias("after"))
    runs = ordered_prefix(edged, ["host"], ["path", "entry"], totals={"run": F.col("before").isNotNull().cast("long")})
    beside = runs.groupBy("host", "run").agg(
        F.first("before", ignorenulls=True).alias("before"), F.first("after", ignorenulls=True).alias("after")
    )
    joined = hot_split_join(runs.drop("before", "after"), beside, ["host", "run"], "inner")
    back, on = (
        F.when(F.col(c).isNull(), -1).otherwise(_common(F.col(c)["path"], F.col("path"))) for c in ("before", "after")
    )
    chosen = joined.select("entry", F.when(back >= on, F.col("before")["entry"]).otherwise(F.col("after")["entry"]).alias("partner"))
    found = cut_lineage(chosen.where("partner is not null"))
    others = entries.select(F.col("entry").alias("partner"), F.col("marks").alias("other"))
    return hot_split_join(found, others, "partner", "inner").select("entry", "other")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """A row per input row: ``key``, ``url``, ``text`` (blocks joined by line ends, empty if none), ``n_chars``.

    A null page is empty. A page without a URL, or alone on its host, or among copies of itself only, has no partner
    and keeps what its markup allows. Ties between partners go to the earlier one in path order.
    Repeated rows are pages of their own; other columns are ignored.

    Pages are parsed twice: first for the hashes of their blocks, by which partners are found, then for their text, which
    travels once, compressed, and is never stored.
    """
    named = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html")
    )
    hashed = named.select("url", "html").mapInArrow(_mark_rows, "url string, marks array<long>")
    light = cut_lineage(hashed.select(_entry(F.col("url"), F.col("marks")).alias("entry"), "url", "marks").where("entry is not null"))
    partners = cut_lineage(_partners(light))
    bodies = named.mapInArrow(_body_rows, "page_id long, url string, body binary, places array<byte>, marks array<long>")
    # pages without a host have no partner; numbers as keys spread them
    spread = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    keyed = bodies.withColumn("entry", F.coalesce(_entry(F.col("url"), F.col("marks")), spread, F.lit("-")))
    joined = hot_split_join(keyed, partners, "entry", "left", hot_from=light)
    out = joined.select("page_id", "url", "body", "places", "marks", "other").mapInArrow(
        _text_rows, "page_id long, url string, text string, n_chars long"
    )
    return out.withColumnsRenamed({"page_id": key, "url": url}) if (key, url) != ("page_id", "url") else out
