"""Quality rules by distribution divergence, with DataFrame functions only.

Every document is compared with the reference of its language: a histogram of character classes and one of the
``COMMON`` commonest words, both taken over all documents of that language. The measure is the Jensen-Shannon
distance (base 2, 0 to 1). Texts under ``MIN_WORDS`` words are too short for a histogram and pass that test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orfloom.functions.arrays import let
from orfloom.session import cut_lineage

BREAK = r"[\x20\x09-\x0D]+"
SOLID = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
COMMON = 12
MIN_WORDS = 50
MAX_CLASS_DISTANCE = 0.32
MAX_WORD_DISTANCE = 0.45
SPAN = 8

MARKS = {"upper": r"A-Z\u00C0-\u00DE", "digit": "0-9", "punctuation": r".,;:!?'\"()\-", "symbol": "#*$%&|<>"}
CLASSES = ("upper", "digit", "punctuation", "symbol", "space", "other")


def _removed(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, F.lit("")))


def with_words(docs: DataFrame, text: str) -> DataFrame:
    """Add ``__text`` (never null), ``__words`` and the character classes ``__c_*``."""
    body = F.col("__text")
    split = docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn(
        "__words", F.array_remove(F.split(body, BREAK), "")
    )
    solid = F.length(F.array_join("__words", ""))
    counted = split.withColumns({
        "__word_chars": solid.cast("long"), **{f"__c_{name}": _removed(body, f"[{letters}]+") for name, letters in MARKS.items()},
    })
    named = F.col("__c_upper") + F.col("__c_digit") + F.col("__c_punctuation") + F.col("__c_symbol")
    return counted.withColumns({
        "__c_space": F.length(body) - F.col("__word_chars"),
        "__c_other": F.col("__word_chars") - named,
    })


def references(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(language, class shares, common words' hashes, word shares with the rest last), a row per language.

    Documents without a language share one reference. One scan gives both: a document's class sums (``kind`` from 0) travel with its
    words (``kind`` -1), and counts are combined in each task before the shuffle.
    """
    keyed = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("__lang"), F.col(text).alias("__raw"))
    rows = with_words(keyed, "__raw")

    def item(kind: int, word: Column, n: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), word.alias("word"), n.cast("long").alias("n"))

    sums = [F.col(f"__c_{c}") for c in CLASSES] + [F.size("__words")]
    items = F.concat(
        F.transform("__words", lambda w: item(-1, F.xxhash64(w), F.lit(1))),
        F.array(*[item(kind, F.lit(0).cast("long"), n) for kind, n in enumerate(sums)]),
    )
    counts = rows.select("__lang", F.inline(items)).groupBy("__lang", "kind", "word").agg(F.sum("n").alias("c"))
    rank = F.row_number().over(Window.partitionBy("__lang", "kind").orderBy(F.desc("c"), "word"))
    top = counts.withColumn("r", rank).where(F.col("r") <= COMMON)
    found = top.groupBy("__lang").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("c"))).alias(c) for k, c in enumerate((*CLASSES, "n"))],
        F.array_sort(F.collect_list(F.when(F.col("kind") == -1, F.struct("r", "word", "c")))).alias("top"),
    )
    all_chars = sum((F.col(c) for c in CLASSES), F.lit(0))
    joined = found.withColumn("__ref_class", F.array(*[F.col(c) / F.greatest(all_chars, F.lit(1)) for c in CLASSES]))
    return joined.select(
        "__lang",
        "__ref_class",
        F.coalesce(F.transform("top", lambda t: t["word"]), F.array().cast("array<long>")).alias("__ref_words"),
        let(
            F.coalesce(F.transform("top", lambda t: t["c"] / F.col("n")), F.array().cast("array<double>")),
            lambda p: F.concat(p, F.array(F.lit(1.0) - F.aggregate(p, F.lit(0.0), lambda a, x: a + x))),
        ).alias("__ref_shares"),
    )


def _plogp(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    parts = F.zip_with(p, q, lambda a, b: _plogp(a, (a + b) / 2) + _plogp(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs at least twice."""

    def of_sorted(rows: Column) -> Column:
        last = F.size(rows) - 1

        def twin(i: Column) -> Column:
            own = rows[i]["h"]
            return F.when((i > 0) & (rows[F.greatest(i - 1, F.lit(0))]["h"] == own), True).otherwise(
                (i < last) & (rows[F.least(i + 1, last)]["h"] == own)
            )

        places = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), last), twin), lambda i: rows[i]["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            places,
            start,
            lambda acc, p: F.struct(
                (p + SPAN).alias("end"), (acc["n"] + p + SPAN - F.greatest(p, acc["end"])).alias("n")
            ),
            lambda acc: acc["n"],
        )

    return let(F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)


def _window_hashes(hashes: Column) -> Column:
    """Hash of every ``SPAN`` consecutive words (a power of two): pairs, pairs of pairs and so on by shifted arrays."""
    n, reach = F.size(hashes), 1
    while reach < SPAN:
        hashes = _combined(hashes, reach)
        reach *= 2
    return F.slice(hashes, 1, n - SPAN + 1)


def _combined(hashes: Column, reach: int) -> Column:
    def shifted(h: Column) -> Column:
        rest = F.slice(h, reach + 1, F.greatest(F.size(h) - reach, F.lit(0)))
        return F.zip_with(h, rest, lambda a, b: F.xxhash64(a, b))

    return let(hashes, shifted)


RESULTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept",
)


def measured(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows with ``n_words``, base counts, both distances (null where not measured), ``base_failed``, ``kept``.

    A null text has no words and fails the base rule; an empty table gives no rows; repeated rows are measured
    one by one. Columns of the input that carry a result's name are replaced, all others stay whatever their names.
    """
    out = _judged(docs, text, lang)
    return out.select(*[f"__row.`{c}`" for c in docs.columns if c not in RESULTS], *RESULTS)


def _judged(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``_measured`` with ``__one``, null for rejected rows, by an outer explode.

    It keeps the optimizer from moving a filter below the measuring, or merging it with what reads it: either would evaluate
    the measures again for every column that uses them.
    """
    return _measured(docs, text, lang).withColumn("__one", F.explode_outer(F.when(F.col("kept"), F.array(F.lit(True)))))


def _measured(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``__row``, the input's row, beside the results and working columns."""
    refs = cut_lineage(references(docs, text, lang))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text).alias("__raw"),
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("__lang"),
    )
    rows = with_words(keyed, "__raw").withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    n = F.size("__words")
    windows = F.when(n >= SPAN, _window_hashes(F.col("__hashes")))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(SOLID))
    based = rows.withColumns({"__windows": windows, "__lines": lines}).withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.col("__word_chars"),
        "n_symbols": F.col("__c_symbol").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("__windows").isNull(), F.lit(0))
        .when(F.size("__windows") == F.size(F.array_distinct("__windows")), F.lit(0))
        .otherwise(_covered(F.col("__windows")))
        .cast("long"),
    })
    joined = based.join(refs, "__lang", "left")
    chars = F.greatest(F.length("__text"), F.lit(1))
    class_shares = F.array(*[F.col(f"__c_{c}") / chars for c in CLASSES])
    shares = let(
        F.transform("__ref_words", lambda k: (n - F.size(F.array_remove("__hashes", k))) / n),
        lambda p: F.concat(p, F.array(F.lit(1.0) - F.aggregate(p, F.lit(0.0), lambda a, x: a + x))),
    )
    long_enough = F.col("n_words") >= MIN_WORDS
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = joined.withColumns({
        "class_distance": F.when(long_enough, js_distance(class_shares, F.col("__ref_class"))),
        "word_distance": F.when(long_enough, js_distance(shares, F.col("__ref_shares"))),
        "base_failed": failed,
    })
    apart = (F.col("class_distance") > MAX_CLASS_DISTANCE) | (F.col("word_distance") > MAX_WORD_DISTANCE)
    return scored.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(apart, F.lit(False)))


def passed(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose verdict is ``kept``, with the columns of the input."""
    marked = _judged(docs, text, lang)
    return marked.where("__one is not null").select(*[f"__row.`{c}`" for c in docs.columns])
