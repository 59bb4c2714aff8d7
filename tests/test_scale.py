"""The skew paths give the rows of the plain paths, and iterative operators agree with brute force."""

import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from orfloom.operators import clusters, context, evaluation, review, sampling, splits
from orfloom.operators.ordering import hash_position, ordered_prefix, permuted, with_neighbours
from orfloom.operators.skew import checked_small, hot_split_join, lookup_join, pairs_join, small_values


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def skewed(spark):
    """2,000 rows; one key holds a third, some keys are null, some have no lookup row."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 97)
    return spark.range(2000).select("id", key.alias("k")).repartition(4)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_hot_split_join_equals_plain_join(spark, skewed, how, null_safe):
    lookup = spark.range(80).select(F.when(F.col("id") != 79, F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    right = lookup.withColumnRenamed("k", "rk")
    match = skewed.k.eqNullSafe(right.rk) if null_safe else skewed.k == right.rk
    plain = skewed.join(right, match, how).select("id", "k", "v")
    for hot_rows in (10, 100, 10_000):
        assert rows_of(hot_split_join(skewed, lookup, "k", how, null_safe, hot_rows)) == rows_of(plain)
    assert rows_of(lookup_join(skewed, lookup, "k", how, null_safe)) == rows_of(plain)
    assert rows_of(lookup_join(skewed, lookup, "k", how, null_safe, small_rows=10, hot_rows=100)) == rows_of(plain)


def test_hot_limit_grows_until_broadcasts_fit(spark, skewed, monkeypatch):
    lookup = spark.range(80).select(F.col("id").alias("k"), F.repeat(F.lit("v"), 100).alias("v"))
    plain = rows_of(skewed.join(lookup, "k", "inner").select("id", "k", "v"))
    from orfloom.operators import skew

    real = skew.checked_small
    monkeypatch.setattr(skew, "checked_small", lambda df, *a: real(df, 3))
    assert rows_of(hot_split_join(skewed, lookup, "k", "inner", hot_rows=2)) == plain


def test_size_checks(spark):
    assert checked_small(spark.range(5), 4) is None
    assert checked_small(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError):
        small_values(spark.range(20), "id", 10)
    wide = spark.range(50).select(F.repeat(F.lit("x"), 10_000).alias("s"), F.array_repeat(F.lit(1.0), 10).alias("v"))
    assert checked_small(wide, 100, 400_000) is None
    assert checked_small(wide, 100, 600_000).count() == 50
    odd = spark.createDataFrame([(None, None, None), ("é", [], {"k": 1})], "`a.b` string, v array<double>, m map<string,int>")
    assert checked_small(odd).count() == 2 and checked_small(odd.limit(0)).count() == 0


@pytest.mark.parametrize("part", [[], ["k"]])
def test_ordered_prefix(spark, skewed, part):
    got = ordered_prefix(skewed, part, ["id"], "pos", {"run": F.col("id") + 1})
    groups, want = defaultdict(list), []
    for r in skewed.collect():
        groups[r.k if part else None].append((r.id, r.k))
    for members in groups.values():
        run = 0
        for pos, (i, k) in enumerate(sorted(members)):
            run += i + 1
            want.append((i, k, pos, run))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select("id", "k", "pos", "run").collect())


def test_hash_position_is_a_permutation(spark, skewed):
    placed = hash_position(skewed.withColumn("d", F.md5(F.col("id").cast("string"))), ["k"], "d", "id")
    window = Window.partitionBy("k").orderBy("d", "id")
    plain = placed.withColumn("rn", (F.row_number().over(window) - 1).cast("long"))
    assert plain.where("rn <> position").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12, 97, 1000, 10_007])
def test_permuted_is_a_bijection(spark, n):
    """Every place once, another order for another seed, and no trace of the old order."""
    got = [r[0] for r in spark.range(n).orderBy("id").select(permuted(F.col("id"), n, 5, F.lit("x"))).collect()]
    assert sorted(got) == list(range(n))
    if n > 90:
        other = [r[0] for r in spark.range(n).orderBy("id").select(permuted(F.col("id"), n, 6, F.lit("x"))).collect()]
        assert sum(x == y for x, y in zip(got, other)) < 10 and sum(i == x for i, x in enumerate(got)) < 10
        assert abs(sum(got[: n // 2]) / (n // 2) - n / 2) < n / 5


@pytest.mark.parametrize("block_rows", [7, 50])
def test_neighbours_of_hot_groups(spark, skewed, block_rows):
    payload = {"x": F.col("id")}
    plain = with_neighbours(skewed, ["k"], ["id"], payload, 4)
    split = with_neighbours(skewed, ["k"], ["id"], payload, 4, hot_rows=30, block_rows=block_rows)
    assert rows_of(plain) == rows_of(split)


def test_context_features_of_hot_groups(spark, skewed):
    args = (["k"], ["id"], "id", F.col("id"), F.lit("+"), F.lit("a"))
    assert rows_of(context.context_features(skewed, *args)) == rows_of(context.context_features(skewed, *args, hot_rows=20))


def test_exact_dedup_of_a_hot_text(spark, skewed):
    texts = skewed.withColumn("text", F.concat(F.lit("t"), F.col("k")))
    found = {r.member: r.rep for r in clusters.exact_dedup(texts, "id", "text", hot_rows=50).collect()}
    first = {}
    for r in sorted(texts.where("text is not null").collect(), key=lambda r: r.id):
        first.setdefault(r.text, r.id)
        assert found[r.id] == first[r.text]


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)]
    edges += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = clusters.connected_components(
        spark.range(300), spark.createDataFrame(edges, "a long, b long"), hot_rows=20
    )
    assert {r.id: r.component for r in got.collect()} == {i: find(i) for i in range(300)}


def test_near_duplicate_links_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("ACDEFGHIKL") for _ in range(rng.randrange(60, 120))) for _ in range(25)]
    texts = [t[:i] + rng.choice("MN") + t[i + 1:] for t in base for i in (0, 20, 40)] + base + ["AC"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, s string")

    def kmers(t):
        return {t[i:i + 6] for i in range(max(len(t) - 6, 0) + 1)}

    want = {}
    for i, t in enumerate(texts):
        for j in range(i):
            a, b = kmers(t), kmers(texts[j])
            if min(len(t), len(texts[j])) >= 0.8 * max(len(t), len(texts[j])) and len(a & b) / max(len(a), len(b)) >= 0.3:
                want[j, i] = round(len(a & b) / max(len(a), len(b)), 9)
    for hot_rows, block_rows in ((3, 2), (10**6, 1024)):
        full = clusters.near_duplicate_edges(docs, "id", "s", 6, hot_rows=hot_rows, block_rows=block_rows)
        assert {(r.rep, r.member): round(r.similarity, 9) for r in full.collect()} == want
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in enumerate(texts):
        for j in range(i):
            a, b = kmers(t), kmers(texts[j])
            if min(len(t), len(texts[j])) >= 0.8 * max(len(t), len(texts[j])) and len(a & b) / max(len(a), len(b)) >= 0.3:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    for hot_rows, block_rows in ((3, 2), (10**6, 1024)):
        members = clusters.near_dup_cluster(docs, "id", "s", k=6, hot_rows=hot_rows, block_rows=block_rows)
        assert {r.member: r.rep for r in members.collect()} == {i: find(i) for i in range(len(texts))}


def test_frequent_pieces_are_known_to_all_tasks(spark):
    """A third of all texts are near copies: their pieces are beyond the hot limit of every shard, and nothing is lost."""
    rng = random.Random(6)

    def text(n):
        return "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))

    base = text(300)
    copies = [base[:k] + "--" + base[k + 2 :] for k in range(0, 280)]
    rows = copies + [text(250) for _ in range(300)] + [text(40)[: k % 7] for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(rows)), "id int, s string")
    found = {r.member: r.rep for r in clusters.near_dup_cluster(docs, "id", "s", k=8, block_rows=50).collect()}
    assert all(found[i] == 0 for i in range(len(copies)))
    short = {}
    for i, t in enumerate(rows[len(copies) :], len(copies)):
        assert found[i] == (short.setdefault(t, i) if t else i)
    assert clusters.near_dup_cluster(docs.limit(0), "id", "s").count() == 0


def test_near_duplicates_beside_a_longer_text_that_quotes_both(spark):
    rng = random.Random(8)

    def text(n):
        return "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))

    a = text(200)
    b = a[:100] + "W" + a[101:]
    quoting = text(150) + a + text(150) + b + text(150)
    # a chain of one-sided overlaps, a text of its own, an empty and a null one
    long = text(400)
    rows = [a, b, quoting, long[:200], long[100:300], long[200:], text(200), "", None]
    docs = spark.createDataFrame(list(enumerate(rows)), "id int, s string")
    for block_rows in (1, 1024):
        found = clusters.near_dup_cluster(docs, "id", "s", block_rows=block_rows)
        assert {r.member: r.rep for r in found.collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 8}


def test_vector_clusters_take_the_nearest_mean(spark):
    rng = random.Random(2)
    rows = [(i, [(i % 3 == d) * 10 + rng.gauss(0, 0.5) for d in range(3)]) for i in range(120)]
    found = review.vector_clusters(spark.createDataFrame(rows, "id int, v array<double>"), "v", 3).collect()
    members = defaultdict(list)
    for r in found:
        members[r.cluster].append(r.v)
    means = {c: [sum(x) / len(vs) for x in zip(*vs)] for c, vs in members.items()}
    for r in found:
        assert r.cluster == min(means, key=lambda c: sum((x - y) ** 2 for x, y in zip(r.v, means[c])))
    assert sorted(map(len, members.values())) == [40, 40, 40]


def greedy_one_by_one(classes, rows, supervised, ratios, alpha):
    ratios = [Fraction(str(r)) for r in ratios]
    have, out = [[0, 0] for _ in ratios], []
    for total, sup, units in classes:
        placed = [0, 0, 0]
        for _ in range(units):
            scores = [
                (rows * r - h[0]) / max(rows * r, 1) + alpha * ((supervised * r - h[1]) / max(supervised * r, 1))
                for r, h in zip(ratios, have)
            ]
            k = scores.index(max(scores))
            placed[k] += 1
            have[k][0] += total
            have[k][1] += sup
        out.append((total, sup, *placed))
    return out


@pytest.mark.parametrize("ratios", [(0.7, 0.15, 0.15), (0.5, 0.25, 0.25), (0.34, 0.33, 0.33), (1.0, 0.0, 0.0)])
def test_class_quotas_equal_unit_by_unit_placement(spark, ratios):
    classes = [(900, 400, 3), (50, 20, 400), (7, 7, 1500), (7, 0, 700), (3, 2, 1), (1, 1, 2011), (1, 0, 1333)]
    rows = sum(t * n for t, _, n in classes)
    supervised = sum(s * n for _, s, n in classes)
    table = spark.createDataFrame(classes[::-1], "total_count long, supervised_count long, units long")
    got = splits.class_quotas(table, rows, supervised, ratios)
    assert sorted(map(tuple, got.collect())) == sorted(greedy_one_by_one(classes, rows, supervised, ratios, Fraction(1, 2)))


def test_quotas_of_a_huge_class_are_exact():
    quotas = splits.Quotas(10**15, 10**14, (0.7, 0.15, 0.15))
    assert quotas.place(1, 0, 10**15 - 10**14) == [630_000_000_000_000, 135_000_000_000_000, 135_000_000_000_000]
    assert sum(quotas.place(1, 1, 10**14)) == 10**14


def test_balanced_split_is_a_partition_without_leaks(spark, skewed):
    rows = skewed.withColumn("status", F.when(F.col("id") % 4 == 0, "open_set").otherwise("trainable_core"))
    out = splits.balanced_group_split(rows, "k")
    assert out.count() == 2000 and out.where("split is null").count() == 0
    assert [r.crossing for r in splits.leakage_report(out, ["k"]).collect()] == [0]
    with pytest.raises(ValueError):
        splits.balanced_group_split(rows, "k", ratios=(0.7, 0.2, 0.2))


@pytest.mark.parametrize("p, q", [(1.0, 1.0), (0.5, 0.0)])
def test_draws_follow_the_chances(spark, p, q):
    """One cluster holds a third of the rows, one group most of it; counts stay within five deviations of the chances."""
    rows = [(i, "hot", 0 if i < 500 else i % 7) for i in range(600)] + [(600 + i, f"c{i % 20}", i % 3) for i in range(1_200)]
    table = spark.createDataFrame(rows, "id long, c string, e long").repartition(4)
    n = 30_000
    got = {r.id: r["count"] for r in sampling.balanced_draws(table, "c", "e", "id", n, 3, p=p, q=q).groupBy("id").count().collect()}
    assert sum(got.values()) == n
    clusters, groups = defaultdict(int), defaultdict(int)
    for _, c, e in rows:
        clusters[c] += 1
        groups[c, e] += 1
    total = sum(k**-p for k in clusters.values())
    inner = {c: sum(k**-q for (o, _), k in groups.items() if o == c) for c in clusters}
    by_group, wanted = defaultdict(int), {}
    for i, c, e in rows:
        by_group[c, e] += got.get(i, 0)
        wanted[c, e] = n * clusters[c] ** -p / total * groups[c, e] ** -q / inner[c]
    for g, want in wanted.items():
        assert abs(by_group[g] - want) < 5 * want**0.5 + 1
    first = sampling.balanced_draws(table, "c", "e", "id", 200, 3, p=p, q=q, shuffle_within_group=False)
    least = {(c, e): min(i for i, oc, oe in rows if (oc, oe) == (c, e)) for _, c, e in rows}
    assert {r.id for r in first.collect()} <= set(least.values())


def test_sampling(spark, skewed):
    rows = skewed.select("id", F.coalesce("k", F.lit(-1)).alias("c"), (F.col("id") % 11).alias("e"))
    chances = sampling.sampling_probability(rows, "c", "e", hot_rows=100)
    assert chances.count() == 2000
    assert abs(chances.agg(F.sum("sampling_probability")).first()[0] - 1) < 1e-9
    draws = sampling.balanced_draws(rows, "c", "e", "id", 3000, seed=1)
    assert sorted(r.draw for r in draws.collect()) == list(range(3000))
    assert rows_of(draws) == rows_of(sampling.balanced_draws(rows.repartition(7), "c", "e", "id", 3000, seed=1))
    assert rows_of(draws) != rows_of(sampling.balanced_draws(rows, "c", "e", "id", 3000, seed=1, epoch=1))
    shuffled = sampling.epoch_permutation(rows, "id", 4500, seed=1).collect()
    assert sorted(r.sample_no for r in shuffled) == list(range(4500))
    assert len({r.id for r in shuffled if r.sample_no < 2000}) == 2000


def test_confusion_of_very_many_classes(spark):
    """50,000 classes: cells and totals stay linear."""
    rows = spark.range(60_000).select((F.col("id") % 50_000).alias("t"), ((F.col("id") * 7 + 3) % 50_000).alias("p"))
    cells = evaluation.confusion_cells(rows, "t", "p")
    totals = evaluation.class_totals(cells)
    assert totals.count() == 50_000
    assert totals.agg(F.sum("as_target"), F.sum("as_pred")).first() == (60_000, 60_000)
    assert cells.agg(F.sum("n")).first()[0] == 60_000 and cells.where("n > target_n or n > pred_n").count() == 0


def test_null_predictions_are_misses(spark):
    rows = spark.createDataFrame([("a", 1, 1, 0.5), ("a", 1, None, 0.1), ("a", 2, 2, None), ("a", None, 2, 0.3)], "split string, t int, p int, g double")
    assert evaluation.accuracy(rows, {"x": ("t", "p")}).first()[0] == pytest.approx(2 / 3)
    assert evaluation.macro_f1(rows, "t", "p").first()[0] == pytest.approx((2 / 3 + 1) / 2)
    bundle = evaluation.Bundle(rows, {"x": ("t", "p")}, "split", ["g"])
    got = bundle.metrics().first()
    assert (got.rows, got.accuracy, got.macro_f1) == (3, pytest.approx(2 / 3), pytest.approx(5 / 6))
    assert {(r["class"], r.rows, r.g) for r in bundle.gates_by_class("x").collect()} == {("1", 2, 0.3), ("2", 1, None)}
    assert evaluation.Bundle(rows.limit(0), {"x": ("t", "p")}).metrics().count() == 0


@pytest.mark.parametrize("means_bytes", [1, 200, 1 << 20])
def test_nearest_mean_in_any_number_of_rounds(spark, means_bytes):
    rng = random.Random(9)
    rows = [(i, rng.choice("abcdefg"), [rng.gauss(0, 1) for _ in range(5)]) for i in range(120)] + [(200, "a", None), (201, None, [0.0] * 5)]
    table = spark.createDataFrame(rows, "id int, label string, vec array<double>")
    sums = defaultdict(list)
    for _, c, v in rows:
        if c is not None and v is not None:
            sums[c].append(v)
    means = {c: [sum(x) / len(vs) for x in zip(*vs)] for c, vs in sums.items()}
    for r in evaluation.prototype_distance(table, "label", "vec", 1.0, means_bytes=means_bytes).collect():
        if r.vec is None:
            assert (r.nearest, r.distance, r.abstain) == (None, None, None)
            continue
        want = min((sum((x - y) ** 2 for x, y in zip(r.vec, m)) ** 0.5, c) for c, m in means.items())
        assert r.nearest == want[1] and r.distance == pytest.approx(want[0]) and r.abstain == (want[0] > 1.0)
    assert evaluation.prototype_distance(table.limit(0), "label", "vec").count() == 0


def test_pairs_join_deals_the_pairs_of_a_key(spark):
    left = spark.range(300).select(F.when(F.col("id") % 40 == 1, F.lit(None)).otherwise(F.col("id") % 3).alias("k"), F.col("id").alias("x"))
    right = spark.range(500).select((F.col("id") % 4).alias("k"), F.floor(F.col("id") / 2).alias("y"))
    plain = rows_of(left.join(right, "k"))
    assert rows_of(pairs_join(left, right, "k")) == plain
    dealt = pairs_join(left, right, "k", block_rows=16, pairs_per_task=1_000)
    assert rows_of(dealt) == plain
    sizes = [r[0] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]
    assert len(sizes) > 20 and max(sizes) < len(plain) / 8  # three keys, many tasks
    assert pairs_join(left.limit(0), right, "k").count() == 0


def test_a_piece_travels_once_in_a_few_bytes():
    from orfloom.operators import kmers

    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefgh", k=3_000)) for _ in range(300)]
    texts[1] = texts[0][:2_000] + texts[1][2_000:]
    batch = pa.record_batch([pa.array(range(300), pa.int64()), pa.array(texts)], names=["num", "text"])
    none = np.zeros(0, np.uint64)
    asked = pa.Table.from_batches(kmers._ask(12, 0.3, 4, none, none.astype(np.int64))(iter([batch])))
    sent = sum(len(v) for c in asked.columns[1:] for v in c.to_pylist())
    assert sent < 5 * 300 * 2_989
    met = [kmers._answer(4)(asked.filter(pc.equal(asked["shard"], s))) for s in range(4)]
    homes = pa.concat_tables(met)
    rows = [kmers._prefix(0.3)(homes.filter(pc.equal(homes["home"], h))) for h in range(4)]
    found = pa.concat_tables(rows).to_pydict()
    both = [k for k in set(found["kmer"]) if {n for n, x in zip(found["num"], found["kmer"]) if x == k} >= {0, 1}]
    need = found["need"][0]
    assert need > 100 and len(both) >= need


def test_keys_equal_within_a_text_lower_its_bounds(monkeypatch):
    from orfloom.operators import kmers

    monkeypatch.setattr(kmers, "KEY_BITS", 24)
    rng = random.Random(6)
    batch = pa.record_batch([pa.array([7]), pa.array(["".join(rng.choices("abcdefgh", k=60_000))])], names=["num", "text"])
    ((_, _, n, _, keys),) = kmers._sets_of(iter([batch]), 12, 0.3)
    hidden = len(kmers.piece_sets(batch.column(1).to_pylist(), 12)[1]) - len(keys)
    least = (hidden + len(keys)) * 0.3 - hidden  # keys that a linked text shares at least
    assert hidden > 0 and least - 0.6 < n[0] * 0.3 <= least + 1e-9


def shares_of(texts, k):
    """Brute force: the share of common pieces of all pairs of fitting lengths."""
    sets = [{t[i : i + k] for i in range(max(len(t) - k, 0) + 1)} for t in texts]
    for j, b in enumerate(texts):
        for i, a in enumerate(texts[:j]):
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                yield i, j, len(sets[i] & sets[j]) / max(len(sets[i]), len(sets[j]))


@pytest.mark.parametrize("ids", ["whole", "text"])
def test_links_by_turns_groups_and_chunks_against_brute_force(spark, monkeypatch, ids):
    """Words from a small vocabulary, so that most pieces are shared: every bound is met by pairs near 0.3."""
    from orfloom.operators import postings

    for name, value in (("ONE_TURN_PIECES", 0), ("TURNS", 3), ("GROUP_ROWS", 300), ("CHUNK_PAIRS", 50), ("SMALL_BYTES", 40)):
        monkeypatch.setattr(postings, name, value)
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(60)]

    def text(n):
        return " ".join(rng.choices(words, k=n))

    base = [text(rng.randrange(20, 60)) for _ in range(30)]
    texts = base + [t[: len(t) * part // 10] + text(60)[: len(t) * (10 - part) // 10] for t in base for part in (3, 4, 5, 8)]
    texts = list(dict.fromkeys(texts + [t + "!" for t in base[:12]] + ["ab", "abc"]))
    want = {(i, j): round(s, 9) for i, j, s in shares_of(texts, 6) if s >= 0.3}
    assert sum(s < 0.4 for s in want.values()) > 10
    name = (lambda i: i) if ids == "whole" else (lambda i: f"t{i:04d}")
    docs = spark.createDataFrame([(name(i), t) for i, t in enumerate(texts)], f"id {'int' if ids == 'whole' else 'string'}, s string")
    found = clusters.near_duplicate_edges(docs, "id", "s", 6, block_rows=4).collect()
    assert {(r.rep, r.member): round(r.similarity, 9) for r in found} == {(name(i), name(j)): s for (i, j), s in want.items()}
    if ids == "text":
        least = list(range(len(texts)))
        for _ in texts:
            for i, j in want:
                least[i] = least[j] = min(least[i], least[j])
        members = clusters.near_dup_cluster(docs, "id", "s", k=6, block_rows=4).collect()
        assert {r.member: r.rep for r in members} == {name(i): name(x) for i, x in enumerate(least)}


def test_near_duplicates_leave_less_on_disk_than_the_texts(spark, monkeypatch, tmp_path):
    """Shuffles of pieces go when their turn ends, and only the lists of shared rare pieces stay."""
    import time
    from pathlib import Path

    from orfloom import session

    rng = random.Random(13)
    texts = ["".join(rng.choices("abcdefghijklmnop", k=3_000)) for _ in range(700)]
    texts[1] = texts[0][:2_000] + texts[1][2_000:]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, s string").repartition(8)
    monkeypatch.setattr(session, "checkpoint_root", lambda s: str(tmp_path))
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def used():
        return sum(f.stat().st_size for top in (*local, tmp_path) for f in Path(top).rglob("*") if f.is_file() and "broadcast" not in f.name)

    before = used()
    links = clusters.near_duplicate_edges(docs, "id", "s")
    assert [(r.rep, r.member) for r in links.collect()] == [(0, 1)]
    for _ in range(50):  # Spark removes the files in the background
        if (left := used() - before) < 2_100_000:
            break
        time.sleep(0.2)
    assert left < 2_100_000


def test_distinct_texts_keeps_the_first_row_of_each_text(spark, monkeypatch):
    rows = [(5, "a"), (3, "a"), (4, None), (9, "b"), (2, ""), (7, ""), (8, "c"), (1, "c")]
    docs = spark.createDataFrame(rows, "id long, s string")
    want = [(1, "c"), (2, ""), (3, "a"), (9, "b")]
    assert sorted(map(tuple, clusters.distinct_texts(docs, "id", "s").collect())) == want
    monkeypatch.setattr(clusters, "SMALL_BYTES", 24)
    assert sorted(map(tuple, clusters.distinct_texts(docs, "id", "s").collect())) == want
