"""Line de-duplication, Merkle manifest and source divergence: brute force, hot paths and edge rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orfloom.llm import linededup, merkle, perfect, recount
from orfloom.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "\n".join(f"line number {i % 900} of many" for i in range(20_000))
EDGE = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, LONG, None, "a", 5), (4, LONG + "\n", "en", None, 5),
    (5, "One two three\n  ONE TWO three\t\nshort", "fr", "b", 1), (5, "One two three\n  ONE TWO three\t\nshort", "fr", "b", 1),
    (5, "another text of five\none two three", "fr", "b", 2), (6, " \t\n\n\x0b", "fr", "b", 3), (None, "one two three\nnull key here", "fr", "b", 4),
    (None, "null key here", "", "", 4), (7, "Ünï çode 日本語 ÜÜ\nünï çode 日本語 ÜÜ\nÜnï çode 日本語 ÜÜ", "de", "c", 9),
    (-3, "ünï Çode 日本語 üü\nünï çode 日本語 ÜÜ\r", "de", "c", 9), (9, "日本語日本語日本語\n" * 3, "ja", "c", 9), (10, "日本語日本語日本語", "ja", "c", 9),
]


@pytest.fixture(scope="module")
def edge(spark):
    """Columns named like results and internals beside the edge rows."""
    rows = spark.createDataFrame(EDGE, SCHEMA)
    return rows.selectExpr("*", "1 as n_lines", "'x' as leaf", "2 as grp", "3 as position", "4 as shard", "'y' as term", "5 as doc", "6 as ref", "7 as block")


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_merkle_manifest", "op13_source_divergence"])
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR)
    assert ok, note


def test_perfect_hash_is_minimal_and_survives_storage():
    rnd = np.random.default_rng(1)
    first = rnd.integers(0, 1 << 63, 50_000).astype(np.uint64)
    second = rnd.integers(0, 1 << 63, 50_000).astype(np.uint64)
    first[:2_000] = first[0]  # keys that differ in the second hash only
    table = perfect.PerfectHash.from_bytes(perfect.build(first, second).to_bytes())
    assert sorted(table.slots(first, second).tolist()) == list(range(50_000))
    none = perfect.PerfectHash.from_bytes(perfect.build(first[:0], second[:0]).to_bytes())
    assert none.slots(first[:3], second[:3]).tolist() == [-1] * 3
    order, cuts = perfect.pair_order(np.r_[first, first], np.r_[second, second])
    assert len(cuts) == 50_000 and len(order) == 100_000


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def deduplicated(rows):
    def key(line):
        return lowered(line.strip(" \t\n\x0b\x0c\r"))

    docs = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            docs[key(line)].add(2**63 - 1 if i is None else i)
    out = []
    for i, text in rows:
        own = 2**63 - 1 if i is None else i
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(docs[key(x)]) < 2 or min(docs[key(x)]) == own]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_edges(spark, edge):
    got = linededup.dedup_lines(edge)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    assert sorted(map(tuple, got.collect()), key=str) == deduplicated([(r[0], r[1]) for r in EDGE])
    assert linededup.dedup_lines(edge.limit(0)).count() == 0


def test_line_dedup_of_frequent_lines(spark):
    """Lines above the hot limit are known to all tasks, the others are probed in their shard: the same rows."""
    rnd = random.Random(3)
    common = ["a line in a third of all texts", "another line of very many texts"]
    rows = []
    for i in range(3_000):
        lines = [f"line {rnd.randrange(4_000)} of some texts" for _ in range(rnd.randrange(4))]
        rows.append((i, "\n".join(lines + [c for c in common if rnd.random() < 0.4])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    arrays = linededup.line_arrays(docs, shards=7)
    assert arrays.where("hot").agg(F.sum("n")).first()[0] == 2
    got = linededup.dedup_lines(docs, shards=7)
    assert sorted(map(tuple, got.collect()), key=str) == deduplicated(rows)


def digest(values):
    def one(v):
        raw = None if v is None else str(v).encode()
        return b"-" if raw is None else str(len(raw)).encode() + b":" + raw

    return hashlib.sha256(b"".join(one(v) for v in values)).hexdigest()


def hashed(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """(root, proofs): siblings of each leaf as (left, right) level by level."""
    at, proofs, level = list(range(len(leaves))), [[] for _ in leaves], list(leaves)
    while len(level) > 1:
        runs = [level[k : k + 3] for k in range(0, len(level), 3)]
        for i, p in enumerate(at):
            run = runs[p // 3]
            proofs[i].append((run[: p % 3], run[p % 3 + 1 :]))
            at[i] = p // 3
        level = [hashed(r) for r in runs]
    return level[0], proofs


def manifested(rows):
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        even = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        seen = text.replace("\n", "") if even and text is not None else text
        groups[source].append((i, digest([i, source, lang, n, text]), digest([i, source, lang, n, seen])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        subs[s] = tree([r[1] for r in groups[s]])
    root, tops = tree([subs[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for (i, leaf, held), proof in zip(groups[s], subs[s][1], strict=True):
            steps, folded = proof + tops[k], held
            for left, right in steps:
                folded = hashed([*left, folded, *right])
            flat = hashed([d for left, right in steps for d in left + right])
            out.append((i, leaf, subs[s][0], root, flat, folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_of_edge_rows_and_several_passes(spark, edge, levels):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    more = [(100 + k, f"text\n{k}", "en", "a" if k % 4 else f"s{k}", k) for k in range(47)]
    rows = EDGE + more
    docs = edge.unionByName(spark.createDataFrame(more, SCHEMA), allowMissingColumns=True)
    got = merkle.manifest(docs, fields, shown={"text": merkle.without_breaks(F.col("doc_id"), F.col("text"))}, levels=levels)
    assert got.columns[-1] == "proof"
    found = got.collect()
    assert sorted((tuple(r)[:-1] for r in found), key=str) == manifested(rows)
    for r in found:  # the proof itself leads from the leaf to the root
        assert merkle.fold(r.leaf, [s.asDict() for s in r.proof]) == r.root
    assert merkle.manifest(edge.limit(0), fields, levels=levels).count() == 0
    alone = merkle.manifest(edge.where("doc_id = 9"), fields, levels=levels).first()
    assert alone.leaf == alone.root == alone.subroot and alone.proof == [] and alone.verified


def audited(rows, least):
    word = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    docs = [((lang or ""), (source or ""), word.findall(lowered(text))) for text, lang, source in rows]
    df, found, groups = Counter(), defaultdict(Counter), sorted({d[:2] for d in docs})
    for lang, source, words in docs:
        df.update((lang, w) for w in set(words))
        found[lang, source].update(words)
    out = []

    def p_of(counts, terms):
        below = sum(counts[t] for t in terms) + 2 * len(terms)
        return {t: 1 + 10**9 * (counts[t] + 2) // below for t in terms}

    for lang, source in groups:
        terms = [w for (la, w), n in df.items() if la == lang and n >= least]
        own = p_of(found[lang, source], terms)
        whole = p_of(sum((found[g] for g in groups if g[0] == lang), Counter()), terms)

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        pairs = []
        for la, other in groups:
            if la == lang and other != source:
                q = p_of(found[lang, other], terms)
                pairs.append((-sum(f(own[t], q[t]) for t in terms), other.encode(), other))
        marks = [(-f(own[t], whole[t]), t.encode(), t) for t in terms if found[lang, source][t] and own[t] > whole[t]]
        for part, items, top in (("pair", pairs, None), ("term", marks, 10)):
            out += [(lang, source, part, t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(items)[:top])]
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"round_bytes": 1, "block": 2, "shard_terms": 5}])
def test_divergence_of_edge_rows_and_in_small_pieces(spark, edge, bounds):
    rnd = random.Random(4)
    words = ["Straße", "ÉTÉ", "été", "日本", *[f"w{chr(97 + k)}" for k in range(26)]]
    more = [
        (k, " ".join(rnd.choices(words, k=30)) + " x1y2", rnd.choice(["en", None]), rnd.choice(["a", "b", "c", "d", "é", None]), 1)
        for k in range(200)
    ] + [(500, "alone", "it", "z", 1)]
    docs = edge.unionByName(spark.createDataFrame(more, SCHEMA), allowMissingColumns=True)
    got = recount.divergence_audit(docs, **bounds)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audited([(r[1], r[2], r[3]) for r in EDGE + more], 10)
    assert recount.divergence_audit(edge.limit(0), **bounds).count() == 0


def test_shares_are_exact_beyond_64_bits():
    counts = np.array([0, 5, 9_000_000_001, 10**15], np.int64)
    total = int(counts.sum())
    assert recount.shares(counts, total, 4).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 8) for c in counts]


def test_first_pass_flushes_and_keeps_colliding_terms(monkeypatch):
    monkeypatch.setattr(recount, "FLUSH", 3)
    real = recount.Terms

    class Colliding(real):
        def __init__(self, *args):
            super().__init__(*args)
            self.h1 = self.h1 % np.uint64(2)  # nearly all terms share their first hash

    monkeypatch.setattr(recount, "Terms", Colliding)
    monkeypatch.setattr(recount, "slices", lambda texts: ((k, k + 1, d, o) for k in range(len(texts)) for _, _, d, o in [next(iter(linededup.slices(texts[k : k + 1])))]))
    texts = ["a b c a", "b c d", "d e"]
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "x", "y"]), pa.array([""] * 3), pa.array(texts)], ["lang", "source", "text"])
    total = Counter()
    for out in recount._documents_of(iter([batch])):
        for lang, term, n in zip(*[c.to_pylist() for c in out.columns]):
            total[lang, term.decode()] += n
    assert total == {("x", "a"): 1, ("x", "b"): 2, ("x", "c"): 2, ("x", "d"): 1, ("y", "d"): 1, ("y", "e"): 1}
