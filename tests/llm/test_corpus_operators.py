"""Corpus operators against brute force, round trips and held-out accuracy, and on edge rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from orfloom.llm import langid, lattice, mixing, ngram_lm, packing, pages, partenum, quality, quotes, secrets
from orfloom.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
EDGE = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, LONG, None, "a"), (4, LONG + " x", "en", None), (5, "one two", "fr", "b"),
    (5, "one two", "fr", "b"), (6, " \t\n", "fr", "b"), (None, "null key here", "fr", "b"), (7, "Ünï çode 日本語 #|#", "de", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like results and internals."""
    rows = spark.createDataFrame(EDGE, SCHEMA)
    return rows.selectExpr("*", "1 as n_words", "2 as id", "'x' as topic", "3 as n", "4 as component", "5 as shard")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def jaccard(rows):
    sets = [set() if not (w := WORD.findall(lowered(t))) else {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            both = len(sets[a] & sets[b])
            if both and None not in (i, j) and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), top(i) if i is not None else None) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def test_jaccard_join_equals_all_pairs(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rnd = random.Random(5)
    base = [f"t{rnd.randrange(400)}" for _ in range(60)]
    for k in range(40):  # a chain of copies, each with one more word changed
        base[rnd.randrange(60)] = f"v{k}"
        rows.append((10_000 + k, " ".join(base)))
    rows += [(20_000 + k, " ".join(base[: 3 + k])) for k in range(12)]
    got = partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == jaccard(rows)


def test_jaccard_join_edges(spark, edge):
    got = partenum.jaccard_components(edge)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == jaccard([(r[0], r[1]) for r in EDGE])
    assert partenum.jaccard_components(edge.limit(0)).count() == 0


def test_jaccard_join_repeated_keys(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "h i j k l m"), (3, "h i j k l m")]
    got = partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {1} and got.count() == 4


def test_windows_and_signatures_share_for_similar_sets():
    rnd = np.random.default_rng(3)
    for size in [*range(1, 60), 150, 700]:
        a = np.unique(rnd.integers(0, 1 << 62, size, np.uint64))
        k = len(a) // 9  # the most that may be exchanged at 0.8
        b = np.unique(np.concatenate([a[k:], rnd.integers(0, 1 << 62, k, np.uint64)]))
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            keys, at = partenum.signatures([a, b])
            assert set(keys[at == 0].tolist()) & set(keys[at == 1].tolist())


def base_spans(text):
    kinds = [
        (r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, 2, 8),
        (r"AKIA[A-Z0-9]+", 0, 0, 16), (r"[0-9a-f]+", 0, 0, 32),
    ]
    out = [
        (m.start(), k, m.end()) for k, (p, flags, group, least) in enumerate(kinds)
        for m in re.finditer(p, text or "", flags) if len(m.group(group)) >= least
    ]
    return sorted(out)


def test_secret_base_spans(docs, edge):
    for table in (docs, edge):
        rows = {(r.doc_id, r.text) for r in table.collect()}
        got = {r.doc_id: r for r in secrets.scan(table).collect()}
        for key, text in rows:
            spans = base_spans(text)
            joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
            assert got[key].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
            assert [got[key].n_assign, got[key].n_access, got[key].n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]


def test_secret_literals_follow_constants():
    text = 'key = "x9F-q2Lm8Zt4"\ndb_password = key\nlabel = "hello-world-12"\ntoken_count = 12345678\npwd: "changeme"\n'
    assert [text[a:b] for a, _, b in secrets.literal_spans(text)] == ["x9F-q2Lm8Zt4"]
    assert secrets.redacted(text, secrets.spans_of(text)).startswith('key = "[secret]"')


def test_lattice_links_equal_cosines(spark):
    rnd = np.random.default_rng(1)
    centre = rnd.standard_normal((12, 64))
    x = [c + rnd.standard_normal(64) * 0.07 for c in centre for _ in range(9)] + [centre[0], centre[0] * 2]
    rows = [(k, [float(v) for v in e], k % 2) for k, e in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, rows[0][1], None), (904, [None] * 64, 0)]
    got = {r.vec_id: r for r in lattice.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = np.array([e / np.linalg.norm(e) for e in x])
    linked = (unit @ unit.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    np.fill_diagonal(linked, False)
    want = linked.sum(1)
    assert all(got[k].n_links <= want[k] for k in range(len(x)))
    assert sum(got[k].n_links for k in range(len(x))) >= 0.95 * want.sum() > 0
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(900, 905))
    assert lattice.vector_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_e8_decoding_is_nearest():
    rnd = np.random.default_rng(2)
    x = rnd.standard_normal((200, 8)) * 2
    point = lattice.decode_e8(x) / 2
    apart = ((x - point) ** 2).sum(1)
    for v in lattice.minimal_vectors() / 2:
        assert (apart <= ((x - point - v) ** 2).sum(1) + 1e-9).all()


def test_packing_round_trip(spark, docs, edge):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for table in (docs, edge):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        pieces = packing.pack(table).collect()
        want = Counter()
        for key, text in rows:
            ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
            want[key, len(ids)] += len(ids)
            for p in pieces:
                if p.doc_id == key and p.doc_tokens == len(ids):
                    assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        got = Counter()
        for p in pieces:
            got[p.doc_id, p.doc_tokens] += p.length
        assert got == want
        sequences = {}
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == sequences.get(p.sequence_id, 0)
            sequences[p.sequence_id] = p.offset + p.length
        assert all(n <= 2048 and n & (n - 1) == 0 for n in sequences.values())


def test_packing_gives_added_tokens_their_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "plain", "日本 <|endoftext|><|endoftext|>é", "x <|endof", "text|> y", None]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect() if r.start == 0}
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[key].doc_tokens == len(ids)
        assert got[key].ids_crc32 == zlib.crc32(ids[: got[key].length].tobytes())


def test_packing_seeds_query_with_all_shared_terms():
    seed = np.arange(101, dtype=np.uint64)
    terms = [seed, seed[:100], *([seed[100:]] + [np.array([500 + k], np.uint64) for k in range(9)])]
    assert packing.Shard(terms).neighbours(0).tolist() == [0, 1, 2]
    many = [seed, *[seed[k : k + 1] for k in range(101)]]  # each neighbour shares another term
    assert sorted(packing.Shard(many).neighbours(0).tolist()) == list(range(102))


def test_page_lines_and_sharing():
    source = (
        "<html><head><title>x</title><style>p{}</style></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>Head</h1>"
        "<p>One &amp;\n two<p><b>Three<br>four</b></p><div class='comments'>rude</div></article><footer>foot</footer>"
    )
    assert [line for line, _ in pages.page_lines(source)] == ["Head", "One & two", "Three", "four"]
    assert pages.shared_lines(list("abcd"), list("axcd")) == [True, False, True, True]


def test_pages_differencing_and_edges(spark):
    body = "<body><div>Site name</div><div>{}</div><div>All rights</div></body>"
    rows = [(k, f"http://h.example/a/{k}", body.format(f"text {k}")) for k in range(5)] + [(9, None, None), (10, "http://o.example/", "")]
    got = {r.page_id: r for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k].text for k in range(5)] == [f"text {k}" for k in range(5)]
    assert got[9].text == got[10].text == "" and got[9].n_chars == 0
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_align_menus_and_guard_the_article(spark):
    menu = "<nav><ul><li>Home</li><li>Contact us</li></ul></nav><div class='widget'>{0}</div>"
    with_article = menu + "<article><p>Contact us</p><p>Same words</p><p>text {0}</p></article><footer>Rights</footer>"
    without = "<form>" + menu + "<p>text {0}</p></form><footer>Rights</footer>"
    rows = [(k, f"http://h.example/a/{k}", with_article.format(k)) for k in range(2)]
    rows += [(k, f"http://o.example/a/{k}", without.format(k)) for k in range(2, 4)] + [(4, "http://alone.example/", menu.format(4) + "<p>text 4")]
    rows += [(5, None, "<form><main><p>in main</p></main></form>"), (6, None, "<form><article>in form</article></form>")]
    rows += [(7, None, "<aside><article>teaser</article></aside><article>own</article>"), (8, None, "<div class='comments'><article class='comment'>rude</article></div><p>own")]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(2)] == [f"Same words\ntext {k}" for k in range(2)]  # the menu's line goes, a shared passage stays
    assert [got[k] for k in range(2, 4)] == [f"{k}\ntext {k}" for k in range(2, 4)]  # the LCS decides, not the names
    assert [got[k] for k in range(4, 9)] == ["text 4", "in main", "in form", "own", "own"]


def test_pages_without_article_lose_menus_adverts_and_comments(spark):
    """Blocks that differ from the partner's are no main text if they are a menu, an advert or a comment."""
    body = "<div>Site</div><nav>You: {0}</nav><div class='ad'>Buy {0}</div><p>text {0}</p><div class='comments'><p>rude {0}</p></div>"
    rows = [(k, f"http://h.example/a/{k}", body.format(k)) for k in range(2)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "text 0", 1: "text 1"}


def test_long_quoted_keys_are_names():
    text = '{"' + "x" * 200 + '_db_password": "hV7-kQz2-9LmX"}'
    assert [text[a:b] for name, (a, b) in [p for p in secrets.pairs(text) if not isinstance(p[1], str)]] == ["hV7-kQz2-9LmX"]


def test_pages_inner_copies_find_a_partner(spark):
    body = "<body><div>Site name</div><div>{}</div><div>All rights</div></body>"
    rows = [(k, f"http://h.example/a/p?v={k}", body.format("copy")) for k in range(40)]  # one path
    rows += [(k, f"http://h.example/b/{k}", body.format("gone")) for k in range(100, 140)]  # one content, many paths
    rows += [(50, "http://h.example/c/x", body.format("other")), (60, "http://only.example/a", body.format("x")), (61, "http://only.example/b", body.format("x"))]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[k] for k in range(40)} == {"copy"} and {got[k] for k in range(100, 140)} == {"gone"} and got[50] == "other"
    assert got[60] == got[61] == "Site name\nx\nAll rights"  # copies of itself only


def test_quotes_nested_reply_chain(spark):
    rows = [
        (1, 0, "a", "Hello there"), (1, 1, "b", "> hello  THERE\nMy answer"), (1, 2, "a", ">> hello there\n> My answer\nThanks"),
        (1, 3, "b", "> unknown line"), (2, 1, "b", "> Hello there"), (None, 1, None, None), (1, 2, "a", ">> hello there\n> My answer\nThanks"),
    ]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == len(rows)
    assert (by[1, 2].reply_to, by[1, 2].thread, by[1, 2].depth, by[1, 2].own_text, by[1, 2].max_level) == (1, 0, 2, "Thanks", 2)
    assert by[1, 3].reply_to is None and by[2, 1].reply_to is None and by[1, 1].own_text == "My answer"


def test_language_held_out_accuracy(docs, edge):
    got = langid.predict_language(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and length(text) > 40").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 0
    marks = {r.doc_id: r for r in langid.predict_language(edge).collect()}
    assert all(marks[k].lang_pred == "und" and marks[k].score == 0 for k in (1, 2, 6))
    assert all(0 <= r.score <= 1 for r in marks.values())
    assert langid.predict_language(edge.limit(0)).count() == 0


def test_language_of_many_scripts_and_shared_openings(spark):
    rnd = random.Random(8)
    spans = {"da": (0x61, 26), "nl": (0x61, 26), "el": (0x3B1, 17), "ru": (0x430, 32), "ja": (0x4E00, 300), "zh": (0x5000, 300), "ko": (0xAC00, 300)}
    opening = "ein gemeinsamer anfang aller texte " * 20
    rows = []
    for lang, (first, n) in spans.items():
        words = ["".join(chr(first + rnd.randrange(n)) for _ in range(4)) for _ in range(60)]
        for _ in range(40):
            rows.append((len(rows), lang, opening + " ".join(rnd.choice(words) for _ in range(400))))
            rows.append((len(rows), lang, " ".join(rnd.choice(words) for _ in range(40)).upper()))
    got = langid.predict_language(spark.createDataFrame(rows, "doc_id long, lang string, text string")).where("held_out").collect()
    assert len(got) > 50 and all(r.lang_pred == rows[r.doc_id][1] for r in got)


def test_language_tables_take_the_same_steps():
    rnd = np.random.default_rng(6)
    for symbols in (3, 40, 2000):
        follow = langid.automaton(rnd.integers(1, symbols, 3000))
        dense, hashed = langid.Dense(follow, symbols), langid.Hashed(follow, symbols)
        state, codes = rnd.integers(0, len(follow), 20_000), rnd.integers(0, symbols, 20_000)
        known = rnd.integers(0, len(follow), 5000)
        state = np.r_[state, known]
        codes = np.r_[codes, [next(iter(follow[s]), 0) for s in known.tolist()]]
        a, b = dense.step(state * symbols, codes), hashed.step(state, codes)
        assert ((a & 1) == (b & 1)).all() and ((a >> 1) // symbols == b >> 1).all()


def repeats(words):
    spans = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({i + k for i in range(len(words) - 7) if spans[tuple(words[i : i + 8])] > 1 for k in range(8)})


def test_quality_base_counts(docs, edge):
    for table in (docs, edge):
        got = {(r.doc_id, r.n_words): r for r in quality.measured(table).collect()}
        for r in table.collect():
            text, words = r.text or "", WORD.findall(r.text or "")
            lines = [x for x in text.split("\n") if WORD.search(x)]
            q = got[r.doc_id, len(words)]
            assert (q.word_chars, q.n_symbols) == (sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
            assert (q.n_dup_lines, q.n_repeat_words) == (len(lines) - len(set(lines)), repeats(words))
            assert q.base_failed == (len(words) < 20 or 100 * repeats(words) > 30 * len(words)) and (not q.kept or not q.base_failed)
    assert quality.measured(edge.limit(0)).count() == 0
    kept = quality.measured(docs).where("kept").count()
    assert quality.passed(docs).count() == kept


def test_mixing_meets_margins(docs, edge):
    got = mixing.calibrated(docs).toPandas()
    for margin, power in mixing.EXPONENTS.items():
        tokens = got.groupby(margin).n_tokens.sum()
        target = tokens**power / (tokens**power).sum()
        fitted = (got.n_tokens * got.probability).groupby(got[margin]).sum()
        assert np.abs(fitted / fitted.sum() - target).max() < 1e-4
    assert got.probability.between(0, 1).all() and len(got) == docs.count()
    assert mixing.calibrated(edge).count() == len(EDGE) and mixing.calibrated(edge.limit(0)).count() == 0


def test_lm_equals_counting(docs, edge):
    rows = {r.doc_id: WORD.findall(lowered(r.text)) + ["</s>"] for r in docs.collect()}
    one, two = Counter(), Counter()
    for key, words in rows.items():
        if zlib.crc32(str(key).encode()) % 7 != 2:
            one.update(words)
            two.update(zip(["</s>", *words[:-1]], words, strict=True))
    total, types = Counter(), Counter()
    for (a, _), n in two.items():
        total[a] += n
        types[a] += 1
    n, v = sum(one.values()), len(one)
    for r in ngram_lm.score_texts(docs).collect():
        words, score = rows[r.doc_id], 0.0
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(one[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        for a, b in zip(["</s>", *words[:-1]], words, strict=True):
            p, back = (one[b] + 1) / (n + v + 1), 0.75 * types[a] / total[a] if total[a] else 1.0
            score += math.log10(((two[a, b] - 0.75) / total[a] if two[a, b] else 0.0) + back * p)
        assert abs(score - r.score) <= 0.03 * len(words)  # half a step of the quantisation for each factor
    assert ngram_lm.score_texts(edge).count() == len(EDGE) and ngram_lm.score_texts(edge.limit(0)).count() == 0


def test_elias_fano_find():
    rnd = np.random.default_rng(4)
    for size, top in ((0, 10), (1, 1), (500, 600), (3000, 1 << 40)):
        values = np.unique(rnd.integers(0, top, size, np.uint64)) if size else np.zeros(0, np.uint64)
        wanted = np.concatenate([values, rnd.integers(0, top, 200, np.uint64)])
        at = ngram_lm.ef_find(ngram_lm.ef_arrays(values, top), wanted)
        place = {x: i for i, x in enumerate(values.tolist())}
        assert at.tolist() == [place.get(x, -1) for x in wanted.tolist()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, name):
    ok, note = compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR)
    assert ok, note


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, SF_DIR)
        now = spark.createDataFrame(now.toPandas(), docs.schema)
        assert now.columns == docs.columns and 0 < now.count() <= before.count(), name
        rows = [(r.doc_id, r.text) for r in now.collect()]
        if name == "ngram_jaccard_join":
            assert all(i == c for i, _, c in jaccard(rows))
        if name == "secret_scan":
            assert now.count() == before.count() and not any(base_spans(t) for _, t in rows)
    assert packing.pack(now).count() > 0


def distance(p, q):
    def half(a, b):
        return sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)

    return math.sqrt(max((half(p, q) + half(q, p)) / 2, 0.0))


def test_quality_verdicts_equal_brute_force(docs):
    """Both distances and ``kept`` from plain counting: class sums and the twelve commonest words of each language."""
    marks = ["[A-Z\u00C0-\u00DE]", "[0-9]", "[.,;:!?'\"()\\-]", "[#*$%&|<>]"]

    def classes(text):
        counts = [len(re.findall(m, text)) for m in marks]
        solid = sum(map(len, WORD.findall(text)))
        return [*counts, len(text) - solid, solid - sum(counts)]

    rows = [(r.doc_id, r.text or "", r.lang or "") for r in docs.collect()]
    sums, words = {}, {}
    for _, text, lang in rows:
        old = sums.setdefault(lang, [0] * 6)
        sums[lang] = [a + b for a, b in zip(old, classes(text), strict=True)]
        words.setdefault(lang, Counter()).update(WORD.findall(text))
    got = {r.doc_id: r for r in quality.measured(docs).collect()}
    for i, text, lang in rows:
        own, r = WORD.findall(text), got[i]
        if len(own) < quality.MIN_WORDS:
            assert r.class_distance is None and r.word_distance is None and r.kept == (not r.base_failed)
            continue
        whole = words[lang]
        common = whole.most_common(12)
        assert len(whole) < 13 or sorted(whole.values())[-13] < common[-1][1]  # no tie decides the list
        total, mine = sum(whole.values()), Counter(own)
        p, q = [mine[w] / len(own) for w, _ in common], [n / total for _, n in common]
        word_distance = distance([*p, 1 - sum(p)], [*q, 1 - sum(q)])
        class_distance = distance([c / max(len(text), 1) for c in classes(text)], [c / sum(sums[lang]) for c in sums[lang]])
        assert r.word_distance == pytest.approx(word_distance, abs=1e-6) and r.class_distance == pytest.approx(class_distance, abs=1e-6)
        apart = class_distance > quality.MAX_CLASS_DISTANCE or word_distance > quality.MAX_WORD_DISTANCE
        assert r.kept == (not r.base_failed and not apart)


PROSE = "the quick brown fox jumps over the lazy dog while the old man looks on and thinks of the long way back to the town".split()


def prose(seed):
    rnd = random.Random(seed)
    return " ".join(f"{rnd.choice(PROSE)}{rnd.randrange(30) or ''}" for _ in range(80)) + "."


def test_pipeline_keeps_every_distinct_text(spark):
    """Several texts under one id, rows without an id, nulls, repeated rows, clashing names, an empty table."""
    import corpus_pipeline

    rows = [(7, prose(1)), (7, prose(2)), (7, prose(1)), (3, prose(2) + " again"), (None, prose(3)), (None, prose(4)), (9, prose(5)), (9, None), (11, "")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    odd = table.selectExpr("*", "1 as key", "2 as __text", "3 as component_id", "4 as kept", "5 as n", "6 as __p", "7 as __row")
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"]
    got = stage(spark, odd, SF_DIR)
    assert got.columns == odd.columns
    want = [(3, prose(2) + " again"), (7, prose(1)), (9, None), (9, prose(5)), (11, ""), (None, prose(3)), (None, prose(4))]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    kept = dict(corpus_pipeline.STAGES)["quality_rules"](spark, odd, SF_DIR)
    assert kept.columns == odd.columns and kept.count() == 7
    for first in (table, table.limit(0)):
        now = first
        for _, step in corpus_pipeline.STAGES:
            now = corpus_pipeline.cut_lineage(step(spark, now, SF_DIR))
        assert (now.count() > 0) == (not first.isEmpty())
