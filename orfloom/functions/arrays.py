"""Vector, probability and local-graph expressions on array columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Logit of an absent modality and floor of probabilities.
MASKED_LOGIT = -1e4
FLOOR = 1e-8


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: an expression used inside a lambda runs per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def one_hot(offset: int | Column, low: int, high: int) -> Column:
    here = F.lit(offset) if isinstance(offset, int) else offset
    return F.transform(F.sequence(F.lit(low), F.lit(high)), lambda x: (x == here).cast("double"))


def chain_star_adjacency(mask: Column, centre: int) -> Column:
    """Symmetric 0/1 matrix: neighbouring valid slots are linked, and every valid slot to the centre."""

    def cell(i: Column, valid_i: Column):
        def value(valid_j: Column, j: Column) -> Column:
            linked = (F.abs(i - j) == 1) | (i == centre) | (j == centre)
            return (valid_i & valid_j & (i != j) & linked).cast("double")

        return value

    return let(mask, lambda m: F.transform(m, lambda valid_i, i: F.transform(m, cell(i, valid_i))))


def chain_star_rows(valid: list[Column], centre: int) -> Column:
    """``chain_star_adjacency`` for a fixed number of slots, written out cell by cell."""

    def cell(i: int, j: int) -> Column:
        if i == j or not (abs(i - j) == 1 or centre in (i, j)):
            return F.lit(0.0)
        return (valid[i] & valid[j]).cast("double")

    slots = range(len(valid))
    return F.array(*[F.array(*[cell(i, j) for j in slots]) for i in slots])


def encode_array(c: Column) -> Column:
    return F.to_json(c)


def decode_array(c: Column, n: int, element: str = "double") -> Column:
    """Array from JSON text; an array of another length is an error."""
    parsed = F.from_json(c, f"array<{element}>")
    wrong = F.raise_error(F.lit(f"expected {n} elements")).cast(f"array<{element}>")
    return F.when(c.isNull(), F.lit(None)).when(F.size(parsed) == n, parsed).otherwise(wrong)


def feature_vector(names: list[str], present: list[str]) -> Column:
    """Fixed-order vector; null values and names not among ``present`` columns give 0."""
    zero = F.lit(0.0)
    return F.array(*[F.coalesce(F.col(n).cast("double"), zero) if n in present else zero for n in names])


def vector_ok(v: Column) -> Column:
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def softmax(v: Column) -> Column:
    def shifted(xs: Column) -> Column:
        return let(F.array_max(xs), lambda top: F.transform(xs, lambda x: F.exp(x - top)))

    def scaled(exps: Column) -> Column:
        return let(total(exps), lambda s: F.transform(exps, lambda x: x / s))

    return let(let(F.transform(v, lambda x: x.cast("double")), shifted), scaled)


def masked_softmax(v: Column, mask: Column) -> Column:
    return softmax(F.zip_with(v, mask, lambda x, m: F.when(m, x.cast("double")).otherwise(F.lit(MASKED_LOGIT))))


def argmax(v: Column) -> Column:
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def modality_mask(*cols: Column) -> Column:
    return F.array(*[c.isNotNull() for c in cols])


def topk(v: Column, k: int) -> Column:
    """The k largest entries as array<struct<score,idx>>, equal scores in index order; NaN is the largest, null comes last."""

    def entry(x: Column, i: Column) -> Column:
        score = x.cast("double")
        return F.struct(score.isNull().alias("none"), (~F.isnan(score)).alias("usual"), (-score).alias("neg"), i.cast("int").alias("idx"))

    best = F.slice(F.sort_array(F.transform(v, entry)), 1, k)
    return F.transform(best, lambda p: F.struct((-p["neg"]).alias("score"), p["idx"].alias("idx")))


def topk_indices(best: Column) -> Column:
    return F.array_join(F.transform(best, lambda p: p["idx"].cast("string")), ",")


def topk_scores(best: Column) -> Column:
    """The scores with six decimals, rounded as C and Python do: by the exact binary value, ties to even."""
    return _six_decimals(F.filter(F.transform(best, lambda p: p["score"]), lambda x: x.isNotNull()))


@F.pandas_udf(T.StringType())
def _six_decimals(scores: pd.Series) -> pd.Series:
    # the printf of the JVM rounds the shortest decimal form half up: 2 ** -7 would become 0.007813
    return scores.map(lambda xs: None if xs is None else ",".join(["%.6f" % x for x in xs]))


def clip_prob(p: Column) -> Column:
    return F.greatest(p.cast("double"), F.lit(FLOOR))


def nll(probs: Column, target: Column) -> Column:
    return -F.log(clip_prob(F.get(probs, target)))


def parent_probs(child: Column, parent_of: list[int], parents: int) -> Column:
    """Child probabilities summed per parent; children with a negative parent are left out."""
    sums = []
    for p in range(parents):
        members = [F.get(child, F.lit(c)).cast("double") for c, up in enumerate(parent_of) if up == p]
        value = F.lit(0.0)
        for m in members:
            value = value + m
        sums.append(value)
    return F.array(*sums)


def kl_to_parent(child: Column, parent: Column, parent_of: list[int], parents: int) -> Column:
    """KL divergence of the parent head from the child head's probabilities summed per parent."""
    if not any(up >= 0 for up in parent_of):
        return F.lit(0.0)
    terms = F.zip_with(
        parent_probs(child, parent_of, parents),
        parent,
        lambda target, p: clip_prob(target) * (F.log(clip_prob(target)) - F.log(clip_prob(p))),
    )
    return total(terms)


def gated_fuse(base: Column, vectors: list[Column], logits: Column, mask: Column) -> Column:
    """struct<gates, fused>: ``base`` plus each present vector times its softmax gate."""

    def add(total_so_far: Column, vector: Column, factor: Column) -> Column:
        return F.zip_with(total_so_far, vector, lambda b, v: b.cast("double") + factor * v.cast("double"))

    def combine(gates: Column) -> Column:
        fused = base
        for i, vector in enumerate(vectors):
            present = F.get(mask, F.lit(i)).cast("double")
            fused = add(fused, vector, F.get(gates, F.lit(i)) * present)
        return F.struct(gates.alias("gates"), fused.alias("fused"))

    return let(masked_softmax(logits, mask), combine)
