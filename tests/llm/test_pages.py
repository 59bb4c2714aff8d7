"""Page differencing against a plain search for partners, and edge rows."""

from __future__ import annotations

import random

from orfloom.llm import pages

SCHEMA = "page_id long, url string, html string"


def plain_texts(rows):
    """Main text of pages without article, whose paths differ: partner by a search over the host's pages in path order."""
    hosts = {}
    for page, url, lines in rows:
        host, *path = url.removeprefix("http://").split("/")
        hosts.setdefault(host, []).append(([""] + path, page, lines))
    texts = {}
    for found in hosts.values():
        found.sort()
        for k, (path, page, lines) in enumerate(found):
            def common(other):
                n = 0
                while n < min(len(path), len(other[0])) and path[n] == other[0][n]:
                    n += 1
                return n

            before = next((x for x in reversed(found[:k]) if x[2] != lines), None)
            after = next((x for x in found[k + 1 :] if x[2] != lines), None)
            sides = [x for x in (before, after) if x is not None]
            partner = max(sides, key=common) if sides else None  # the first of equals
            shared = pages.shared_lines(lines, partner[2]) if partner else [False] * len(lines)
            texts[page] = "\n".join(line for line, cut in zip(lines, shared, strict=True) if not cut)
    return texts


def test_partners_and_texts_agree_with_a_plain_search(spark):
    rnd = random.Random(4)
    rows, paths = [], set()
    while len(rows) < 300:
        host = rnd.choice(["one.example", "two.example", "three.example"]) if len(rows) > 1 else "lone.example" + str(len(rows))
        path = "/".join(rnd.choice("abcd") + str(rnd.randrange(4)) for _ in range(rnd.randrange(1, 5)))
        if (host, path) in paths:
            continue
        paths.add((host, path))
        lines = [f"top of {host}"] + [f"line {rnd.randrange(12)}" for _ in range(rnd.randrange(6))] + ["bottom"]
        if rnd.random() < 0.4:
            lines = [f"top of {host}", "copied", "bottom"]
        rows.append((len(rows), f"http://{host}/{path}", lines))
    made = [(k, url, "".join(f"<p>{line}</p>" for line in lines)) for k, url, lines in rows]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(made, SCHEMA).repartition(7)).collect()}
    assert got == plain_texts(rows)


def test_nulls_repeats_long_pages_and_clashing_columns(spark):
    long = "".join(f"<p>word {k} of a long page</p>" for k in range(20_000))
    rows = [
        (1, "http://h.example/a", "<div>Site</div>" + long), (2, "http://h.example/b", "<div>Site</div><p>short</p>"),
        (2, "http://h.example/b", "<div>Site</div><p>short</p>"), (None, "http://h.example/c", "<div>Site</div><p>no id</p>"),
        (3, None, "<p>no url &amp; no host</p>"), (3, None, "<p>no url &amp; no host</p>"), (4, "http://h.example/d", None), (5, "", ""),
        (6, "not a url", "<nav>only a menu</nav>"), (None, None, None),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as entry", "2 as marks", "'x' as host", "3 as text", "4 as n_chars", "5 as other")
    got = pages.main_text(frame).collect()
    texts = sorted((r.page_id or 0, r.text) for r in got if r.page_id != 1)
    assert texts == [(0, ""), (0, "no id"), (2, "short"), (2, "short"), (3, "no url & no host"), (3, "no url & no host"), (4, ""), (5, ""), (6, "")]
    whole = next(r for r in got if r.page_id == 1)
    assert whole.text.count("\n") == 19_999 and whole.n_chars == len(whole.text)
    renamed = spark.createDataFrame(rows, SCHEMA).toDF("id", "address", "source")
    assert pages.main_text(renamed, "id", "address", "source").columns == ["id", "address", "text", "n_chars"]
