"""Quotation linking, with DataFrame functions only.

Lines that start with ``>`` are quoted, one level per mark; consecutive lines of one level are a passage, whatever the
width they were wrapped at: its lines are joined and normalised (lower case, one space for white space). The original of
a quoted passage of at least ``RUN`` words is the first message of the conversation that wrote its words in one passage
of its own. Hashes of word runs find it: a quote looks up its rarest run only, and only if all its runs occur, and the
texts decide. A shorter passage is repeated by chance, so it must equal a whole passage or line of a message, and the
latest such message before the quote is its original. A message answers the original of its longest level-one passage
that has one. Threads are followed up to their first message by pointer doubling, and every message gets its place in
the conversation: thread by thread, in the order of replies, without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orfloom.operators.ordering import ordered_prefix
from orfloom.session import cut_lineage

MARKS = r"^(?:[\x20\x09-\x0D]*>)+"
WHITE = r"[\x20\x09-\x0D]+"
QUOTES = r"(?m)^[\x20\x09-\x0D]*>"
RUN = 5
SMALL = 1_000_000  # conversation ids, 8 bytes each, in one broadcast


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), WHITE, " "))


def _level(line: Column) -> Column:
    lead = F.regexp_extract(line, MARKS, 0)
    return F.length(lead) - F.length(F.replace(lead, F.lit(">"), F.lit("")))


def _lines(text: Column) -> Column:
    """Level, normalised text and raw text of every line."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda x: F.struct(_level(x).alias("level"), _normal(x).alias("line"), x.alias("raw")),
    )


def _passages(lines: Column) -> Column:
    """Level and text of every passage with a word: a line end and the level before each change of level, then a split."""

    def marked(ls: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            starts = (i == 0) | (F.get(ls, i - 1)["level"] != line["level"])
            lead = F.when(starts, F.concat(F.lit("\n"), line["level"].cast("string"), F.lit(":"))).otherwise(F.lit(" "))
            return F.concat(lead, line["line"])

        return F.array_join(F.transform(ls, one), "")

    # an array of one binds the lines once for all that looks at them
    parts = F.split(F.get(F.transform(F.array(lines), marked), F.lit(0)), "\n")
    found = F.transform(
        parts,
        lambda p: F.struct(
            F.substring_index(p, ":", 1).try_cast("int").alias("level"),
            F.trim(F.regexp_replace(F.regexp_replace(p, "^[0-9]+:", ""), " +", " ")).alias("text"),
        ),
    )
    return F.filter(found, lambda p: p["text"] != "")


def _runs(words: Column) -> Column:
    """Distinct hashes of the runs of ``RUN`` words; of texts with at least so many."""
    bound = F.transform(
        F.array(words),
        lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - RUN + 1), lambda i: F.xxhash64(F.slice(w, i, RUN))),
    )
    return F.array_distinct(F.get(bound, F.lit(0)))


def _within(part: Column, whole: Column) -> Column:
    """Whole words of ``part`` stand in a row in ``whole``."""
    return F.contains(F.concat(F.lit(" "), whole, F.lit(" ")), F.concat(F.lit(" "), part, F.lit(" ")))


def _of_conversations(messages: DataFrame, quoted: DataFrame) -> DataFrame:
    """The messages of conversations with such a quote; the ids are broadcast if there are at most ``SMALL``."""
    ids = quoted.select("conv_id").distinct()
    return messages.join(F.broadcast(ids) if ids.count() <= SMALL else ids, "conv_id", "left_semi")


def _first_writers(own: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv_id, text, origin) of the long quoted passages that some message wrote, with the first that did.

    Both sides are distinct texts of a conversation, so copies meet once. The pairs compared are those of a quote and the
    own passages that hold the quote's rarest run.
    """
    # numbers of written rows are fixed, and shorter than digests on every run
    texts = own.groupBy("conv_id", "text").agg(F.min("turn").alias("first"))
    own = cut_lineage(texts.withColumn("own", F.monotonically_increasing_id()))
    asked = cut_lineage(asked.select("conv_id", "text").distinct().withColumn("ask", F.monotonically_increasing_id()))
    wanted = cut_lineage(
        asked.select("conv_id", "ask", _runs(F.split("text", " ")).alias("runs"))
        .select("conv_id", "ask", F.size("runs").alias("n_runs"), F.explode("runs").alias("run"))
    )
    held = cut_lineage(
        own.select("conv_id", "own", F.explode(_runs(F.split("text", " "))).alias("run"))
        .join(wanted.select("conv_id", "run").distinct(), ["conv_id", "run"], "left_semi")
    )
    counts = held.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        wanted.join(counts, ["conv_id", "run"])
        .groupBy("conv_id", "ask")
        .agg(
            F.count(F.lit(1)).alias("n_met"), F.first("n_runs").alias("n_runs"),
            F.min(F.struct("n", "run"))["run"].alias("run"),
        )
        .where("n_met = n_runs")
    )
    pairs = rarest.join(held, ["conv_id", "run"]).select("conv_id", "ask", "own")
    written = own.select("conv_id", "own", "first", F.col("text").alias("whole"))
    return (
        pairs.join(asked, ["conv_id", "ask"]).join(written, ["conv_id", "own"])
        .where(_within(F.col("text"), F.col("whole")))
        .groupBy("conv_id", "text").agg(F.min("first").alias("origin"))
    )


def _latest_writers(own: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv_id, text, turn, origin): the latest message before ``turn`` that wrote exactly this text.

    Writers before a place in the order of turns are counted by running totals, so a phrase that everyone writes and
    quotes neither meets itself in pairs nor passes through one task.
    """
    keys = ["conv_id", "text", "turn"]
    asked = asked.select(*keys).distinct()
    wrote = own.select(*keys).distinct().join(asked.select("conv_id", "text").distinct(), ["conv_id", "text"], "left_semi")
    both = asked.withColumn("wrote", F.lit(0).cast("long")).unionByName(wrote.withColumn("wrote", F.lit(1).cast("long")))
    counted = cut_lineage(ordered_prefix(both, ["conv_id", "text"], ["turn", "wrote"], totals={"k": F.col("wrote")}))
    writers = counted.where("wrote = 1").select("conv_id", "text", "k", F.col("turn").alias("origin"))
    return counted.where("wrote = 0 and k > 0").join(writers, ["conv_id", "text", "k"]).select(*keys, "origin")


def _threads(answers: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of all answers, by pointer doubling: as many rounds as the depth has binary digits."""
    jumps = cut_lineage(
        answers.where("reply_to is not null").select(
            "conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")
        )
    )
    while True:
        up = jumps.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("r2"), F.col("depth").alias("d2"))
        if jumps.join(up, ["conv_id", "root"], "left_semi").isEmpty():
            return jumps
        jumps = cut_lineage(
            jumps.join(up, ["conv_id", "root"], "left").select(
                "conv_id", "turn", F.coalesce("r2", "root").alias("root"),
                (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"),
            )
        )


def link_quotes(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """A row per message: own text without quotes, quote counts, the message it answers, thread, depth and place.

    ``n_linked`` counts the distinct (level, passage) with an original, ``reply_to`` is the original of the longest
    level-one passage (ties: the latest original). ``place`` numbers the messages of a conversation from 0: threads by
    their first message, in them messages by depth, then turn, so that none stands before the one it answers.

    A null text is empty. Messages with a null conversation or turn link with nothing, are a thread of their own and have
    no place. Rows that repeat a (conversation, turn) are one message with the passages of all, and come out as often.
    Only earlier turns are originals. An empty table gives no rows. Other columns are ignored.
    """
    named = messages.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"),
    )
    rows = named.withColumn("lines", _lines(F.col("text")))
    keyed = rows.where("conv_id is not null and turn is not null")
    message = ["conv_id", "turn"]
    words = F.size(F.split("text", " "))
    passages = keyed.where(F.col("text").rlike(QUOTES)).select(*message, F.explode(_passages(F.col("lines"))).alias("p"))
    quoted = cut_lineage(
        passages.where("p.level > 0").select(*message, "p.level", "p.text").distinct().withColumn("n_words", words)
    )
    long, short = quoted.where(F.col("n_words") >= RUN), quoted.where(F.col("n_words") < RUN)
    own = _passages(F.col("lines"))
    own = F.transform(F.filter(own, lambda p: p["level"] == 0), lambda p: p["text"])
    single = F.transform(F.filter("lines", lambda l: (l["level"] == 0) & (l["line"] != "")), lambda l: l["line"])
    wrote = _of_conversations(keyed, long).select(*message, F.explode(own).alias("text")).where(words >= RUN)
    brief = _of_conversations(keyed, short).select(*message, F.explode(F.concat(own, single)).alias("text")).where(words < RUN)
    first = long.join(_first_writers(wrote, long), ["conv_id", "text"])
    latest = short.join(_latest_writers(brief, short), ["conv_id", "text", "turn"])
    found = first.unionByName(latest).where("origin < turn")
    top = F.col("level") == 1
    answers = cut_lineage(
        found.groupBy(*message).agg(
            F.count(F.lit(1)).alias("n_linked"),
            F.max(F.when(top, F.struct("n_words", "origin")))["origin"].alias("reply_to"),
        )
    )
    threaded = (
        keyed.select(*message).distinct().join(answers, message, "left").join(_threads(answers), message, "left")
        .select(
            *message, F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to",
            F.coalesce("root", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        )
    )
    placed = ordered_prefix(threaded, ["conv_id"], ["thread", "depth", "turn"], position="place")
    raw = F.transform(F.filter("lines", lambda l: l["level"] == 0), lambda l: l["raw"])
    out = rows.select(
        *message, "role",
        F.regexp_replace(F.array_join(raw, "\n"), rf"^{WHITE}|{WHITE}\z", "").alias("own_text"),
        F.size(F.filter("lines", lambda l: l["level"] > 0)).cast("long").alias("n_quoted_lines"),
        F.aggregate("lines", F.lit(0), lambda a, l: F.greatest(a, l["level"])).cast("long").alias("max_level"),
    ).join(placed, message, "left")
    return out.select(
        F.col("conv_id").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), "own_text", "n_quoted_lines",
        "max_level", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to",
        F.coalesce("thread", F.col("turn")).alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "place",
    )


def conversations(linked: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The linked messages range-partitioned and sorted: each conversation thread by thread, in the order of replies."""
    return linked.repartitionByRange(conv, "place").sortWithinPartitions(conv, "place")


SQL = r"""
WITH RECURSIVE raw AS (
  SELECT row_number() OVER () AS id, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
l AS (
  SELECT id, conv_id, turn, i, ls[i] AS raw,
    length(regexp_extract(ls[i], '^(?:[\x20\x09-\x0D]*>)+')) - length(replace(regexp_extract(ls[i], '^(?:[\x20\x09-\x0D]*>)+'), '>', '')) AS level,
    trim(regexp_replace(lower(regexp_replace(ls[i], '^(?:[\x20\x09-\x0D]*>)+', '')), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM raw)),
keyed AS (SELECT * FROM l WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
turned AS (
  SELECT *, CASE WHEN lag(level) OVER (PARTITION BY id ORDER BY i) IS DISTINCT FROM level THEN 1 ELSE 0 END AS starts FROM keyed),
grouped AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM turned),
joined AS (
  SELECT conv_id, turn, level, string_agg(line, ' ' ORDER BY i) AS text FROM grouped WHERE line <> '' GROUP BY id, conv_id, turn, level, g),
units AS (SELECT DISTINCT conv_id, turn, level, text, len(string_split(text, ' ')) AS n_words FROM joined),
quoted AS (SELECT * FROM units WHERE level > 0),
short AS (
  SELECT conv_id, turn, text FROM units WHERE level = 0 AND n_words < 5
  UNION SELECT conv_id, turn, line FROM keyed WHERE level = 0 AND line <> '' AND len(string_split(line, ' ')) < 5),
found AS (
  SELECT q.conv_id, q.turn, q.level, q.text, q.n_words, min(u.turn) AS origin
  FROM quoted q JOIN units u ON u.conv_id = q.conv_id AND u.turn < q.turn AND u.level = 0
    AND contains(' ' || u.text || ' ', ' ' || q.text || ' ')
  WHERE q.n_words >= 5 GROUP BY ALL
  UNION ALL
  SELECT q.conv_id, q.turn, q.level, q.text, q.n_words, max(s.turn)
  FROM quoted q JOIN short s ON s.conv_id = q.conv_id AND s.turn < q.turn AND s.text = q.text WHERE q.n_words < 5 GROUP BY ALL),
answers AS (
  SELECT conv_id, turn, count(*) AS n_linked, arg_max(origin, [n_words, origin]) FILTER (level = 1) AS reply_to FROM found GROUP BY 1, 2),
up AS (
  SELECT conv_id, turn, reply_to AS root, 1 AS depth FROM answers WHERE reply_to IS NOT NULL
  UNION ALL
  SELECT u.conv_id, u.turn, a.reply_to, u.depth + 1 FROM up u JOIN answers a ON a.conv_id = u.conv_id AND a.turn = u.root
  WHERE a.reply_to IS NOT NULL),
top AS (SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM up GROUP BY 1, 2),
threaded AS (
  SELECT m.conv_id, m.turn, coalesce(n_linked, 0) AS n_linked, reply_to, coalesce(root, m.turn) AS thread, coalesce(depth, 0) AS depth
  FROM (SELECT DISTINCT conv_id, turn FROM raw WHERE conv_id IS NOT NULL AND turn IS NOT NULL) m
  LEFT JOIN answers a ON a.conv_id = m.conv_id AND a.turn = m.turn LEFT JOIN top t ON t.conv_id = m.conv_id AND t.turn = m.turn),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY thread, depth, turn) - 1 AS place FROM threaded),
own AS (
  SELECT id, regexp_replace(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (level = 0), ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z', '', 'g') AS own_text,
    count(*) FILTER (level > 0) AS n_quoted_lines, max(level) AS max_level FROM l GROUP BY id)
SELECT r.conv_id, r.turn, r.role, own_text, n_quoted_lines, CAST(max_level AS BIGINT) AS max_level,
  CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, reply_to, coalesce(thread, r.turn) AS thread,
  CAST(coalesce(depth, 0) AS BIGINT) AS depth, place
FROM raw r JOIN own USING (id) LEFT JOIN placed p ON p.conv_id = r.conv_id AND p.turn = r.turn"""
