"""Sequence clean-up, tokens and overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orfloom.functions.arrays import let
from orfloom.functions.text import strip


def sanitize_seq(c: Column) -> Column:
    """Upper-cased, stripped sequence with the rare residues U, Z, O and B written as X."""
    return F.translate(strip(F.upper(c)), "UZOB", "XXXX")


def space_residues(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)(.)(?=.)", "$1 ")


def placeholder_residues(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)(.)", "$1#")


def pair_tokens(c: Column) -> Column:
    """Two-character tokens; an odd length is an error."""
    pairs = F.regexp_extract_all(c, F.lit(r"(?s)(..)"), F.lit(1))
    empty = F.array().cast("array<string>")
    odd = F.raise_error(F.concat(F.lit("odd token text length: "), F.length(c).cast("string"))).cast("array<string>")
    return F.when(F.length(c) % 2 == 1, odd).when(F.length(c) == 0, empty).otherwise(pairs)


def seq_len(c: Column) -> Column:
    return F.length(c)


def check_window(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError(f"need size > 0 and 0 <= overlap < size, got {size} and {overlap}")


def window_count(length: Column, size: int, overlap: int) -> Column:
    check_window(size, overlap)
    step = size - overlap
    extra = F.floor((length - F.lit(size) + F.lit(step - 1)) / F.lit(step))
    return F.when(length <= size, F.lit(1)).otherwise(extra + 1).cast("int")


def windows(length: Column, size: int, overlap: int) -> Column:
    """array<struct<start,end>> covering [0, length); the last window is moved left to keep its size."""
    step = size - overlap

    def spans(n: Column) -> Column:
        last = F.greatest(n - F.lit(size), F.lit(0))

        def bounds(i: Column) -> Column:
            start = F.least(i * F.lit(step), last).cast("int")
            return F.struct(start.alias("start"), F.least(start + F.lit(size), n).cast("int").alias("end"))

        return F.transform(F.sequence(F.lit(0), window_count(n, size, overlap) - 1), bounds)

    return let(length, spans)


def coverage_weights(wins: Column) -> Column:
    """Residues each window covers first; the weights of a sequence add up to its length."""

    def weight(ws: Column):
        def of(w: Column, i: Column) -> Column:
            covered = F.when(i == 0, F.lit(0)).otherwise(F.get(ws, i - 1)["end"])
            return F.greatest(w["end"] - F.greatest(w["start"], covered), F.lit(1)).cast("int")

        return of

    return let(wins, lambda ws: F.transform(ws, weight(ws)))


def windowed_text(seq: Column, length: Column, size: int, overlap: int) -> Column:
    """array<struct<weight,text>> of a sequence cut to ``length``.

    Windows are cut from the fixed-width encoding, so a cut costs the same anywhere in a long sequence.
    """

    def cut(wide: Column, ws: Column):
        def piece(w: Column, i: Column) -> Column:
            covered = F.when(i == 0, F.lit(0)).otherwise(F.get(ws, i - 1)["end"])
            text = F.decode(F.substr(wide, w["start"] * 4 + 1, (w["end"] - w["start"]) * 4), "UTF-32")
            new = F.greatest(w["end"] - F.greatest(w["start"], covered), F.lit(1)).cast("int")
            return F.struct(new.alias("weight"), text.alias("text"))

        return piece

    return let(
        F.encode(seq, "UTF-32"), lambda wide: let(windows(length, size, overlap), lambda ws: F.transform(ws, cut(wide, ws)))
    )


def window_text(seq: Column, win: Column) -> Column:
    return F.substr(seq, win["start"] + 1, win["end"] - win["start"])


def effective_len(length: Column, size: int, strategy: str) -> Column:
    if strategy not in ("truncate", "sliding_windows"):
        raise ValueError(f"unknown long-sequence strategy {strategy!r}")
    return F.least(length, F.lit(size)) if strategy == "truncate" else length


def is_truncated(length: Column, size: int, strategy: str) -> Column:
    return (effective_len(length, size, strategy) < length)
