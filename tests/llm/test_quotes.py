"""Quotation linking: planted quotes, edges, and the SQL twin on tables that hold quotes (the given ones hold none)."""

from __future__ import annotations

import random

import pytest

from orfloom.llm import quotes
from tests.oracle import normal

SCHEMA = "conv_id long, turn long, role string, text string"
BODY = "The parser drops the last field of a row\nwhen the row ends without a line break,\nso the totals are short by one."


def linked(spark, rows):
    got = quotes.link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    return {(r.conv_id, r.turn): r for r in got}


def same_as_sql(spark, rows):
    import duckdb
    import pyarrow as pa

    con = duckdb.connect()
    kinds = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    table = pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(kinds)})
    con.register("conversations", table)
    cursor = con.execute(quotes.SQL)
    want = normal([d[0] for d in cursor.description], cursor.fetchall())
    df = quotes.link_quotes(spark.createDataFrame(rows, SCHEMA))
    assert sorted(df.columns) == sorted(d[0] for d in cursor.description)
    got = df.collect()
    assert normal(df.columns, got) == want
    return got


def test_a_quote_wrapped_at_another_width_finds_its_original(spark):
    wrapped = "\n".join(f"> {p}" for p in ("the parser drops THE LAST", "field of a row when the row ends without a", "line break,   so the totals are short by one."))
    part = "> when the row ends without a line break,\n>\n> so the totals"
    by = linked(spark, [(1, 0, "a", BODY), (1, 1, "b", f"Ann wrote:\n{wrapped}\nI see."), (1, 2, "c", part + "\nMe too"), (1, 3, "c", "> the row ends without a line feed")])
    assert (by[1, 1].reply_to, by[1, 1].n_linked, by[1, 1].own_text) == (0, 1, "Ann wrote:\nI see.")
    assert by[1, 2].reply_to == 0 and by[1, 3].reply_to is None


def test_the_longest_passage_decides_and_short_ones_take_the_latest(spark):
    rows = [
        (1, 0, "a", "Thanks"), (1, 1, "b", "An unrelated and long body of text here\nThanks"), (1, 2, "c", "Thanks\nSomething else"),
        (1, 3, "d", "> An unrelated and long body\n> of text here\n> Thanks\nWelcome"), (1, 4, "e", "> thanks\nFor what?"),
        (1, 5, "f", "> thanks for\nNo such line"),
        (1, 6, "g", "> An unrelated and long body of text here\nYes\n> thanks\nNo"),
    ]
    by = linked(spark, rows)
    assert [by[1, t].reply_to for t in range(3, 7)] == [1, 2, None, 1]
    assert by[1, 6].n_linked == 2 and by[1, 6].own_text == "Yes\nNo"


def test_places_follow_replies(spark):
    texts = ["First subject of all the mails", "Second subject of all the mails", "> second subject of all the mails\nanswer one two three four",
             "> first subject of all the mails\nreply to the very first mail", ">> second subject of all the mails\n> answer one two three four\nthird in the row of answers"]
    rows = [(7, t, "x", text) for t, text in enumerate(texts)]
    by = linked(spark, rows)
    assert [by[7, t].thread for t in range(5)] == [0, 1, 1, 0, 1]
    assert [by[7, t].depth for t in range(5)] == [0, 0, 1, 1, 2]
    assert [by[7, t].place for t in range(5)] == [0, 2, 3, 1, 4]
    told = quotes.conversations(quotes.link_quotes(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [r.turn for r in sorted(told, key=lambda r: r.place)] == [0, 3, 1, 2, 4] and not any(">" in r.own_text for r in told)


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    long = "\n".join(f"line {i} of a very long message {i % 97}" for i in range(4_000))
    rows = [
        (1, 0, "a", long), (1, 1, None, "\n".join("> " + x for x in long.split("\n"))), (1, 2, "c", None), (1, 3, "c", ""), (1, 4, "c", " \t\n>\n> >\n"),
        (None, 1, "a", "> line 1 of a very long message 1"), (2, None, "a", "> line 1 of a very long message 1"), (None, None, None, None),
        (1, 1, "b", "second row of one message"), (1, 5, "d", "> second row of one message\nok"), (1, 5, "d", "> second row of one message\nok"),
    ]
    got = same_as_sql(spark, rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 1].reply_to == 0 and by[1, 5].reply_to == 1 and by[1, 5].depth == 2
    assert by[None, 1].place is None and by[2, None].thread is None and by[1, 4].max_level == 2
    wide = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as place", "2 as level", "'x' as lines", "3 as thread", "4 as origin", "5 as n_words")
    assert quotes.link_quotes(wide).count() == len(rows)
    renamed = spark.createDataFrame(rows, SCHEMA).toDF("c", "t", "who", "body")
    assert quotes.link_quotes(renamed, "c", "t", "who", "body").columns[:3] == ["c", "t", "who"]
    assert quotes.link_quotes(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations_agree_with_sql(spark, seed):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Eps", "zeta", "Éta"]
    rows, own = [], {}
    for conv in range(6):
        for turn in range(60 if conv == 0 else 12):  # one conversation holds a third of all messages and more
            lines = []
            for _ in range(rnd.randrange(1, 4)):
                if turn and rnd.random() < 0.7:
                    said = rnd.choice(own[conv, rnd.randrange(turn)].split("\n")).split()
                    a = rnd.randrange(3)
                    piece = said[a : a + rnd.randrange(1, 20)]
                    width, marks = rnd.randrange(2, 6), ">" * rnd.choice([1, 1, 2, 3])
                    lines += [f"{marks} {' '.join(piece[k : k + width])}" for k in range(0, len(piece), width)]
                lines += ["  ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 16)))]
            own[conv, turn] = "\n".join(x for x in lines if not x.startswith(">"))
            rows.append((conv, turn, rnd.choice("ab"), "\n".join(lines)))
    got = same_as_sql(spark, rows)
    assert sum(r.reply_to is not None for r in got) > 20 and max(r.depth for r in got) >= 2


def test_phrases_that_all_write_and_quote(spark):
    said = "Kind regards\nto all of you from me\n"
    rows = [(1, t, "a", said + ("> kind regards" if t % 2 else "> to all of you\n> from me")) for t in range(400)]
    by = linked(spark, rows)
    assert by[1, 0].reply_to is None
    assert all(by[1, t].reply_to == (t - 1 if t % 2 else 0) for t in range(1, 400))  # short: the latest, long: the first
    assert sorted(r.place for r in by.values()) == list(range(400)) and by[1, 399].depth == 2


def test_a_long_chain_of_replies(spark):
    rows = [(1, t, "a", f"> mail number {t - 1} says this much\nmail number {t} says this much") for t in range(50)]
    by = linked(spark, rows)
    assert all((by[1, t].depth, by[1, t].thread, by[1, t].place) == (t, 0, t) for t in range(50))
