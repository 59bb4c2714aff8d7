"""Divergence between the sources of each language, from a recount over minimal perfect hashes.

The first pass counts, for every language, in how many documents each term occurs; terms below the limit go, an exact
filter by the term's own text. The kept ones form minimal perfect hashes in shards of bounded size, each with its terms stored at
their slots. The second pass reads the documents again, finds every word's slot, compares the stored term byte by byte, and
increments a dense array of slots for each (language, source) group. Shards are broadcast in rounds of at most
``ROUND_BYTES``, so what a worker holds is bounded whatever the vocabulary; a larger one takes more rounds over the documents.
The distances are sums over shards: a task holds the counts of one shard and of one pair of blocks of sources.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orfloom.llm.packed import pack_bytes, unpack_bytes
from orfloom.llm.perfect import PerfectHash, build, pair_order, second_hashes
from orfloom.llm.words import lower_ascii, mix, slices, span_hashes
from orfloom.operators.skew import lookup_join
from orfloom.session import cut_lineage

LEAST = 10
SCALE = 1_000_000_000
TOP = 10
SHARD_TERMS = 65_536
ROUND_BYTES = 64 << 20
FLUSH = 150_000
SLOTS = 8_000_000  # dense counters of a task before they are handed on
BLOCK = 128  # sources of a block of the pair table

_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of all runs of letters and of bytes beyond ASCII; runs never cross a text boundary."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = _TERM[data]
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


@functools.lru_cache(maxsize=65_536)
def _salt(name: str) -> int:
    raw = np.frombuffer(name.encode(), np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0]) if len(raw) else 0


def _salts(names: list[str]) -> np.ndarray:
    return np.array([_salt(n) for n in names], np.uint64)


class Terms:
    """Terms of a slice of texts: spans in lower-cased bytes and the two hashes of (language, term)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        self.data = lower_ascii(data)
        self.starts, self.ends, self.rows = term_spans(self.data, offsets)
        self.h1 = mix(span_hashes(self.data, self.starts, self.ends) ^ mix(langs, 3)[self.rows], 4)
        self.h2 = second_hashes(self.data, self.starts, self.ends) ^ mix(langs, 5)[self.rows]

    def text(self, at: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Terms, list[str], list[str], int]]:
    """(terms, languages, sources, rows) of all slices; columns are lang, source, text."""
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for first, end, data, offsets in slices(batch.column(2)):
            yield Terms(data, offsets, _salts(langs[first:end])), langs[first:end], sources[first:end], end - first


def _documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, documents) combined over a task, or over ``FLUSH`` distinct terms of it."""
    seen: dict[int, list] = {}
    rest: dict[tuple[str, bytes], int] = {}  # terms that share their first hash with another one

    def packed():
        rows = [(e[1], e[2], e[3]) for e in seen.values()] + [(lang, term, n) for (lang, term), n in rest.items()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.int64()))],
            ["lang", "term", "docs"],
        )

    for terms, langs, _, _ in _texts(batches):
        order, cuts = pair_order(terms.h1, terms.h2)
        if not len(cuts):
            continue
        rows = terms.rows[order]  # a stable order: the rows of one term ascend
        new = np.r_[True, rows[1:] != rows[:-1]]
        new[cuts] = True
        counts = np.add.reduceat(new.astype(np.int64), cuts)
        first = order[cuts]
        h1, h2 = terms.h1[first].tolist(), terms.h2[first].tolist()
        unknown = np.array([k for k, h in enumerate(h1) if h not in seen], np.int64)
        fresh = dict(zip(unknown.tolist(), terms.text(first[unknown]), strict=True))
        owner = terms.rows[first].tolist()
        for k, (a, b, n) in enumerate(zip(h1, h2, counts.tolist(), strict=True)):
            entry = seen.get(a)
            if entry is None:
                text = fresh[k] if k in fresh else terms.text(first[k : k + 1])[0]
                seen[a] = [b, langs[owner[k]], text, n]
            elif entry[0] == b:
                entry[3] += n
            else:
                name = (langs[owner[k]], terms.text(first[k : k + 1])[0])
                rest[name] = rest.get(name, 0) + n
        if len(seen) + len(rest) >= FLUSH:
            yield packed()
            seen, rest = {}, {}
    if seen or rest:
        yield packed()


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term, docs) of the terms in at least ``least`` rows of their language; ``docs``: lang, source, text."""
    counted = docs.mapInArrow(_documents_of, "lang string, term binary, docs long")
    total = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    return total.select("lang", F.decode("term", "UTF-8").alias("term"), "docs")


# ---- shards --------------------------------------------------------------------------------------------------

SHARD = "lang string, shard int, n long, perfect binary, letters binary, lengths binary"


def _shard_of_terms(pdf: pd.DataFrame) -> pd.DataFrame:
    lang, shard = str(pdf["lang"].iloc[0]), int(pdf["shard"].iloc[0])
    raw = sorted(t.encode() for t in pdf["term"])
    h1, h2 = _hashes_of(raw, lang)
    mph = build(h1, h2)
    placed = [b""] * len(raw)
    for slot, term in zip(mph.slots(h1, h2).tolist(), raw, strict=True):
        placed[slot] = term
    lengths = pack_bytes(np.array([len(t) for t in placed], np.uint64))
    return pd.DataFrame({
        "lang": [lang], "shard": [shard], "n": [len(raw)], "perfect": [mph.to_bytes()], "letters": [b"".join(placed)], "lengths": [lengths],
    })


def _hashes_of(raw: list[bytes], lang: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    starts = np.r_[0, ends[:-1]]
    salt = _salts([lang])
    return (
        mix(span_hashes(data, starts, ends) ^ mix(salt, 3), 4), second_hashes(data, starts, ends) ^ mix(salt, 5),
    )


def term_shards(terms: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """A written row for each shard of a language's terms: its perfect hash, and the terms' bytes in the order of their slots.

    A language has as many shards as its terms need at ``shard_terms``, by a hash of the term.
    """
    terms = cut_lineage(terms)
    sizes = terms.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_terms)).cast("int").alias("shards"))
    dealt = lookup_join(terms, sizes, "lang", "inner").select(
        "lang", "term", F.pmod(F.xxhash64("term"), "shards").cast("int").alias("shard")
    )
    return cut_lineage(dealt.repartition("lang", "shard").groupBy("lang", "shard").applyInPandas(_shard_of_terms, SHARD))


class Shard:
    """A perfect hash with the bytes of every term, for comparison."""

    def __init__(self, perfect: bytes, letters: bytes, lengths: bytes):
        self.perfect, self.letters = PerfectHash.from_bytes(perfect), letters
        self.bytes = np.frombuffer(letters + b"\0", np.uint8)
        sizes = unpack_bytes(lengths).astype(np.int64)
        self.size, self.ends = len(sizes), np.cumsum(sizes)
        self.starts = self.ends - sizes

    def terms(self) -> list[bytes]:
        return [self.letters[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]

    def find(self, terms: Terms, at: np.ndarray) -> np.ndarray:
        """Slot of each span, -1 where the stored term differs in any byte."""
        slot = self.perfect.slots(terms.h1[at], terms.h2[at])
        length = terms.ends[at] - terms.starts[at]
        safe = np.maximum(slot, 0)
        same = (slot >= 0) & (self.ends[safe] - self.starts[safe] == length)
        left, step = np.flatnonzero(same), 0
        while len(left):
            left = left[length[left] > step]
            equal = self.bytes[self.starts[safe[left]] + step] == terms.data[terms.starts[at[left]] + step]
            same[left[~equal]] = False
            left, step = left[equal], step + 1
        return np.where(same, slot, -1)


COUNTS = "lang string, source string, shard int, slots binary, counts binary"
_COUNTS = pa.schema([
    ("lang", pa.string()), ("source", pa.string()), ("shard", pa.int32()), ("slots", pa.binary()), ("counts", pa.binary()),
])


@functools.lru_cache(maxsize=1)
def _loaded(shards: Broadcast) -> dict[str, list[tuple[int, Shard]]]:
    out: dict[str, list[tuple[int, Shard]]] = {}
    for lang, shard, *stored in shards.value:
        out.setdefault(lang, []).append((shard, Shard(*stored)))
    return out


def _recount(shards: Broadcast):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _loaded(shards)
        dense: dict[tuple[str, str, int], np.ndarray] = {}

        def packed():
            out = []
            for (lang, source, shard), slots in dense.items():
                used = np.flatnonzero(slots)
                if len(used):
                    counts = slots[used].astype(np.uint64)
                    out.append((lang, source, shard, pack_bytes(used.astype(np.uint64)), pack_bytes(counts)))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_COUNTS)], schema=_COUNTS)

        for terms, langs, sources, _ in _texts(batches):
            order, cuts = pair_order(terms.h1, terms.h2)
            if not len(cuts):
                continue
            groups = sorted(set(zip(langs, sources, strict=True)))
            number = {g: k for k, g in enumerate(groups)}
            of_row = np.array([number[g] for g in zip(langs, sources, strict=True)])
            lang_of = [langs[r] for r in terms.rows[order[cuts]].tolist()]  # a key holds its language
            distinct = np.repeat(np.arange(len(cuts)), np.diff(np.r_[cuts, len(order)]))
            owner = of_row[terms.rows[order]]
            first = order[cuts]
            lang_array = np.array(lang_of, object)
            for lang in set(lang_of):
                mine = np.flatnonzero(lang_array == lang)
                for shard, table in known.get(lang, ()):
                    slot = np.full(len(cuts), -1, np.int64)
                    slot[mine] = table.find(terms, first[mine])
                    word = slot[distinct]
                    hit = word >= 0
                    word, group = word[hit], owner[hit]
                    for g in np.unique(group):
                        name = (lang, groups[g][1], shard)
                        if name not in dense:
                            dense[name] = np.zeros(table.size, np.int64)
                        dense[name] += np.bincount(word[group == g], minlength=table.size)
            if sum(len(d) for d in dense.values()) >= SLOTS:
                yield packed()
                dense = {}
        if dense:
            yield packed()

    return rows


def _summed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    slots = np.concatenate([unpack_bytes(s) for s in pdf["slots"]]).astype(np.int64)
    counts = np.concatenate([unpack_bytes(c) for c in pdf["counts"]]).astype(np.int64)
    order = np.argsort(slots, kind="stable")
    slots, counts = slots[order], counts[order]
    cuts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
    return slots[cuts], np.add.reduceat(counts, cuts)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    slots, counts = _summed(pdf)
    head = pdf.iloc[0]
    return pd.DataFrame({
        "lang": [head["lang"]], "source": [head["source"]], "shard": [int(head["shard"])],
        "slots": [pack_bytes(slots.astype(np.uint64))], "counts": [pack_bytes(counts.astype(np.uint64))],
        "total": [int(counts.sum())],
    })


def group_counts(docs: DataFrame, shards: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(lang, source, shard, slots, counts, total) of all groups, a written table: the second pass.

    The shards of a round, at most ``round_bytes`` together (or a single one), are the only thing broadcast.
    """
    weight = F.octet_length("perfect") + F.octet_length("letters") + F.col("n") * 16
    sizes = shards.select("lang", "shard", weight.alias("size")).orderBy("lang", "shard").collect()  # three values a shard
    rounds: list[list] = []
    held = round_bytes + 1
    for row in sizes:
        if held + row["size"] > round_bytes:
            rounds.append([])
            held = 0
        rounds[-1].append((row["lang"], row["shard"]))
        held += row["size"]
    spark = docs.sparkSession
    passes = []
    for names in rounds:
        wanted = spark.createDataFrame(names, "lang string, shard int")
        own = shards.join(F.broadcast(wanted), ["lang", "shard"]).select("lang", "shard", "perfect", "letters", "lengths").collect()
        table = [(r[0], r[1], bytes(r[2]), bytes(r[3]), bytes(r[4])) for r in own]
        passes.append(cut_lineage(docs.mapInArrow(_recount(spark.sparkContext.broadcast(table)), COUNTS)))
    if not passes:
        return spark.createDataFrame([], f"{COUNTS}, total long")
    found = functools.reduce(DataFrame.unionByName, passes)
    return cut_lineage(found.groupBy("lang", "source", "shard").applyInPandas(_merge, f"{COUNTS}, total long"))


# ---- distances -----------------------------------------------------------------------------------------------

def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), exact; counts beyond 64-bit products go through integers."""
    below = total + 2 * terms
    if below < 1 << 63 and (not len(counts) or int(counts.max()) < 9_000_000_000):
        return 1 + (counts.astype(np.int64) + 2) * SCALE // below
    return np.array([1 + SCALE * (int(c) + 2) // below for c in counts], np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)  # at most 10^18


def _dense(row, size: int) -> np.ndarray:
    counts = np.zeros(size, np.int64)
    if isinstance(row["slots"], (bytes, bytearray)):
        counts[unpack_bytes(bytes(row["slots"])).astype(np.int64)] = unpack_bytes(bytes(row["counts"])).astype(np.int64)
    return counts


def _pair_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums over one shard for all pairs of two blocks of sources."""
    head = pdf.iloc[0]
    size, terms = int(head["n"]), int(head["terms"])
    own = {
        row["source"]: (int(row["block"]), shares(_dense(row, size), int(row["group_total"]), terms))
        for _, row in pdf.iterrows()
    }
    a, b = int(head["tile_a"]), int(head["tile_b"])
    out = [
        (head["lang"], s, t, int(divergence(p, q).sum()))
        for s, (i, p) in own.items() if i == a
        for t, (j, q) in own.items() if j == b and (a != b or s < t)
    ]
    return pd.DataFrame(out, columns=["lang", "a", "b", "value"]).astype({"value": np.int64})


def _top_terms(counts: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    """The shard's best ``TOP`` terms of every group of a block of sources."""
    out = []
    if len(counts) and len(shard):
        stored = shard.iloc[0]
        terms = Shard(stored["perfect"], stored["letters"], stored["lengths"]).terms()
        whole = _dense(stored, len(terms))
        q = shares(whole, int(shard["lang_total"].iloc[0]), int(shard["n_terms"].iloc[0]))
        for _, row in counts.iterrows():
            own = _dense(row, len(terms))
            p = shares(own, int(row["group_total"]), int(row["n_terms"]))
            value = divergence(p, q)
            use = np.flatnonzero((own > 0) & (p > q))
            if len(use) > TOP:  # ties with the last value stay
                use = use[value[use] >= np.partition(value[use], len(use) - TOP)[len(use) - TOP]]
            best = sorted((-int(value[k]), terms[k]) for k in use)[:TOP]
            out += [(row["lang"], row["source"], term.decode(), -v) for v, term in best]
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"]).astype({"value": np.int64})


def divergence_audit(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST,
    round_bytes: int = ROUND_BYTES, block: int = BLOCK, shard_terms: int = SHARD_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): sources against each other, and the terms that mark each source.

    Part ``pair``: for each other source of the language, the divergence summed over all kept terms. Part ``term``: the ten terms
    that set the source apart from its language. Null text, lang and source are read as ''. Every row is a document, so repeated
    rows count as often as they occur. A language without kept terms gives pairs of value 0; a single source gives no pair;
    a table without rows gives none. Other columns are ignored.
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    groups = cut_lineage(named.select("lang", "source").distinct())
    shards = term_shards(kept_terms(named, least), shard_terms)
    counts = group_counts(named, shards, round_bytes)
    vocabulary = shards.groupBy("lang").agg(F.sum("n").alias("n_terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("total").alias("group_total"))
    order = Window.partitionBy("lang").orderBy("source")
    members = cut_lineage(
        groups.join(vocabulary, "lang", "left").join(totals, ["lang", "source"], "left")
        .na.fill(0, ["n_terms", "group_total"])
        .withColumn("block", F.floor((F.row_number().over(order) - 1) / F.lit(block)).cast("int"))
    )
    ranked = _pairs(members, shards, counts).withColumn("part", F.lit("pair")).unionByName(
        _terms(members, shards, counts).withColumn("part", F.lit("term"))
    )
    place = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = ranked.withColumn("rank", F.row_number().over(place)).where((F.col("part") == "pair") | (F.col("rank") <= TOP))
    return out.select(F.col("lang").alias(lang), F.col("source").alias(source), "part", "item", "value", "rank")


def _pairs(members: DataFrame, shards: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all pairs of sources of a language, in tiles of two blocks and one shard."""
    blocks = members.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    own = members.join(blocks, "lang")
    # every block meets itself and each other one once: the pairs of blocks it belongs to
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, "block").alias("tile_a"), F.greatest(o, "block").alias("tile_b")),
    )
    tiled = own.select("lang", "source", "block", "n_terms", "group_total", F.explode(tiles).alias("t")).select("*", "t.*").drop("t")
    each = lookup_join(tiled, shards.select("lang", "shard", "n"), "lang", "inner").join(
        counts.select("lang", "source", "shard", "slots", "counts"), ["lang", "source", "shard"], "left"
    )
    sums = each.withColumnRenamed("n_terms", "terms").groupBy("lang", "shard", "tile_a", "tile_b").applyInPandas(
        _pair_sums, "lang string, a string, b string, value long"
    )
    summed = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = summed.select(
        "lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                           F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("p"),
    ).select("lang", "p.source", "p.item", "value")
    bare = members.where("n_terms = 0")
    empty = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    return both.unionByName(empty.select("lang", "source", "item", F.lit(0).cast("long").alias("value")))


def _terms(members: DataFrame, shards: DataFrame, counts: DataFrame) -> DataFrame:
    whole = counts.groupBy("lang", "shard").applyInPandas(
        lambda pdf: _merge(pdf.assign(source="")), f"{COUNTS}, total long"
    ).select("lang", "shard", "slots", "counts")
    langs = members.groupBy("lang").agg(F.sum("group_total").alias("lang_total"), F.max("n_terms").alias("n_terms"))
    tables = shards.select("lang", "shard", "perfect", "letters", "lengths").join(whole, ["lang", "shard"]).join(langs, "lang")
    blocks = members.select("lang", "block").distinct()
    own = counts.select("lang", "source", "shard", "slots", "counts").join(
        members.select("lang", "source", "block", "n_terms", "group_total"), ["lang", "source"]
    )
    keys = ["lang", "shard", "block"]
    return own.groupBy(*keys).cogroup(tables.join(blocks, "lang").groupBy(*keys)).applyInPandas(
        _top_terms, "lang string, source string, item string, value long"
    )


SQL = """
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  coalesce(text, '') AS text FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x{00}-\\x{40}\\x{5B}-\\x{60}\\x{7B}-\\x{7F}]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
groups AS (SELECT DISTINCT lang, source FROM docs),
size AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang),
found AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN found f USING (lang, source, term)),
shares AS (SELECT lang, source, term, n,
  1 + CAST(1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS BIGINT) AS p
  FROM dense JOIN size USING (lang)),
whole AS (SELECT lang, term, 1 + CAST(1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS BIGINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM dense GROUP BY ALL) JOIN size USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce(CAST(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS BIGINT), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
