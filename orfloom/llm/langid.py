"""Language identification by cross-parsing: a text is parsed into the longest phrases that occur in a
language's sample text (Ziv and Merhav, 1993), and the language that needs the fewest phrases wins.

Each language's sample is indexed by a suffix automaton over all its lower-cased letters, and the automaton is laid out
as a table of its own, so that many stretches of text take a step at once: (state, symbol) for a small alphabet, hashed
steps for a large one. A sample is cut out of its document at a place drawn by the key. The sample is bounded (``SAMPLE_DOCS`` documents
of each language, chosen by a digest of the key, ``SAMPLE_CHARS`` characters each); predictions read whole texts, in
stretches of ``STRETCH`` characters that are parsed on their own and summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS = 64
SAMPLE_CHARS = 400
STRETCH = 256
DENSE = 128
LANES = 1 << 13
UNKNOWN = "und"


def training_sample(docs: DataFrame, key: str, text: str, lang: str, usable: Column) -> list[tuple[str, str]]:
    """(language, sample text): at most SAMPLE_DOCS * SAMPLE_CHARS characters for each language."""
    whole = F.col(text).cast("string")
    # a stretch from anywhere in the text: openings that documents share must not teach the model
    start = F.pmod(F.xxhash64(F.col(key), F.lit("start")), F.greatest(F.length(whole) - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"),
        F.xxhash64(F.col(key)).alias("digest"),
        F.substr(whole, start.cast("int"), F.lit(SAMPLE_CHARS)).alias("part"),
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("digest", "part"))
    chosen = rows.withColumn("r", rank).where(F.col("r") <= SAMPLE_DOCS)
    # one row of at most 25,600 characters per language: the number of languages is the number of classes
    lists = chosen.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("r", "part"))).alias("parts"))
    return sorted((r["lang"], "\n".join(p["part"] for p in r["parts"])) for r in lists.toLocalIterator())


def automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Steps (symbol to state) of every state of the suffix automaton of a sequence; a phrase ends where none is."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        if c in follow[last] and length[follow[last][c]] == length[last] + 1:
            last = follow[last][c]
            continue
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p != -1:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return follow


class Dense:
    """Steps of an automaton as one table; an entry is twice the next state, plus one where a phrase has ended.

    A missing step ends the phrase and starts the next one with the same symbol: the entry holds the state after that.
    """

    def __init__(self, follow: list[dict[int, int]], symbols: int):
        table = np.full((len(follow), symbols), -1, np.int64)
        for state, steps in enumerate(follow):
            for c, to in steps.items():
                table[state, c] = to
        on = np.where(table >= 0, table, np.maximum(table[0], 0)[None, :])
        self.table = ((on * symbols) * 2 + (table < 0)).reshape(-1)

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.table[state + codes]


class Hashed:
    """The same entries for an alphabet of any size: the steps that exist stand in a hash table."""

    def __init__(self, follow: list[dict[int, int]], symbols: int):
        self.symbols = symbols
        self.root = np.ones(symbols, np.int64)
        for c, to in follow[0].items():
            self.root[c] = to * 2 + 1
        keys = np.array([s * symbols + c for s, steps in enumerate(follow) for c in steps], np.int64)
        values = np.array([to * 2 for steps in follow for to in steps.values()], np.int64)
        bits = max(1, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]  # of several keys for one slot the last one stays
            put = self.keys[slot] == keys[left]
            self.values[slot[put]] = values[left[put]]
            left, slot = left[~put], (slot[~put] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        keys = state * self.symbols + codes
        slot = self._slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], self.root[codes])
        on = np.flatnonzero((held != keys) & (held >= 0))
        while len(on):  # the slot holds another key: look at the next one
            slot[on] = (slot[on] + 1) & self.mask
            held = self.keys[slot[on]]
            hit = held == keys[on]
            out[on[hit]] = self.values[slot[on[hit]]]
            on = on[~hit & (held >= 0)]
        return out


class Model:
    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        self.letter = np.zeros(0x110000, bool)
        self.lower = np.arange(0x110000, dtype=np.uint32)  # an upper-case character steps like its lower-case form
        for point in range(0x110000):
            char = chr(point)
            self.letter[point] = char.isalpha()
            low = char.lower()
            if low != char and len(low) == 1:
                self.lower[point] = ord(low)
        lowered = [self.lower[self.plain(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4"))[0]] for _, s in samples]
        seen = np.unique(np.concatenate(lowered))
        place = np.zeros(0x110000, np.int64)
        place[seen] = np.arange(1, len(seen) + 1)
        self.code = place[self.lower]
        self.own, self.steps = [], []  # of each language: its symbols (0 for a character it does not have), its steps
        for points in lowered:
            letters = np.unique(points)
            own = np.zeros(len(seen) + 1, np.int64)
            own[place[letters]] = np.arange(1, len(letters) + 1)
            symbols = len(letters) + 1
            self.own.append(own)
            self.steps.append((Dense if symbols <= DENSE else Hashed)(automaton(own[place[points]]), symbols))

    def plain(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters, and one blank for every run of other characters after a letter; and the places kept."""
        letter = self.letter[points]
        keep = np.flatnonzero(letter | np.r_[False, letter[:-1]])
        return np.where(letter[keep], points[keep], np.uint32(32)), keep

    def phrases(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases per (stretch, language); stretches are sorted from the longest to the shortest."""
        n = len(starts)
        count = np.zeros((len(self.langs), n), np.int64)
        for row, own, steps in zip(count, self.own, self.steps, strict=True):
            state = np.zeros(n, np.int64)
            symbols, live = own[codes], n
            for step in range(int(sizes[0]) if n else 0):
                while sizes[live - 1] <= step:
                    live -= 1
                entry = steps.step(state[:live], symbols[starts[:live] + step])
                row[:live] += entry & 1
                np.right_shift(entry, 1, out=state[:live])
            row += state != 0
        return count

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        raw = "\n".join([*(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass")
        edges = np.r_[0, np.cumsum([len(t or "") + 1 for t in texts])].astype(np.int64)
        points, kept = self.plain(np.frombuffer(raw, "<u4"))
        cuts = np.searchsorted(kept, edges)
        has_letter = np.diff(cuts) > 0
        per = -(-np.diff(cuts) // STRETCH)
        owner = np.repeat(np.arange(len(texts)), per)
        starts = np.repeat(cuts[:-1], per) + STRETCH * (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per))
        sizes = np.minimum(STRETCH, cuts[1:][owner] - starts)
        codes = self.code[points].astype(np.int64)
        total = np.zeros((len(texts), len(self.langs)))
        order = np.argsort(-sizes, kind="stable")
        for a in range(0, len(order), LANES):
            part = order[a : a + LANES]
            np.add.at(total, owner[part], self.phrases(codes, starts[part], sizes[part]).T)
        best = total.argmin(1)
        ranked = np.sort(total, 1)
        second = ranked[:, 1] if ranked.shape[1] > 1 else ranked[:, 0] * 2
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(second > 0, 1 - ranked[:, 0] / np.maximum(second, 1), 0.0)
        langs = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, has_letter, strict=True)]
        return langs, [float(s) if ok else 0.0 for s, ok in zip(score, has_letter, strict=True)]


@lru_cache(maxsize=1)
def model_of(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model(samples)


def predict_language(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2
) -> DataFrame:
    """A row per input row: ``key``, ``held_out``, ``lang_pred``, ``score`` (0 to 1: phrases saved over the next best).

    Learns from rows whose crc32(key as text) mod ``folds`` is not ``held``; a null key counts as empty text. Without a
    labelled row, and for a text that is null or has no letter, the answer is ``und`` with score 0. Equal phrase
    counts go to the language that sorts first. Repeated rows get equal answers; other columns are ignored.
    """
    fold = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds
    samples = tuple(training_sample(docs, key, text, lang, fold != held))
    named = docs.select(
        F.col(key).cast("long").alias("doc_id"), (fold == held).alias("held_out"), F.col(text).cast("string").alias("text")
    )
    if not samples:
        return named.select(
            F.col("doc_id").alias(key), "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")
        )
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value)
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                langs, scores = model.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return named.mapInArrow(rows, schema).withColumnRenamed("doc_id", key)
