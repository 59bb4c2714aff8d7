"""Column functions on literal edge rows."""

import pytest
from pyspark.sql import functions as F

from orfloom import functions as fn


def values(spark, column, inputs, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


def test_normalize_annotation(spark):
    inputs = [None, "", "  ", "NA", " nan ", "na", "<No_PHROG_mapping>", "no_phrog_mapping", "  tail\t fiber  x", "None"]
    blank = "unresolved_blank_annotation"
    assert values(spark, fn.normalize_annotation, inputs) == [
        blank, blank, blank, blank, blank, "na", "no_phrog_mapping", "no_phrog_mapping", "tail fiber x", blank,
    ]


def test_is_known(spark):
    inputs = [None, "", " NaN ", "<no_phrog_mapping>", "no_phrog_mapping", "phrog_1"]
    assert values(spark, fn.is_known, inputs) == [0, 0, 0, 0, 1, 1]


def test_len_norm(spark):
    assert values(spark, fn.len_norm, [None, float("nan"), 0.0, 250.0, 5000.0], "double") == [0.0, 0.0, 0.0, 0.25, 1.0]


def test_strand(spark):
    flags = values(spark, fn.strand_flags, [None, "+", " -1 ", "F", "forward"])
    assert [tuple(f) for f in flags] == [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (1.0, 0.0)]
    row = spark.range(1).select(fn.same_strand(F.lit(None).cast("string"), F.lit(None).cast("string")), fn.same_strand(F.lit("+ "), F.lit("+")))
    assert tuple(row.first()) == (True, True)


def test_sequences(spark):
    assert values(spark, fn.sanitize_seq, [" muzob ", None]) == ["MXXXX", None]
    assert values(spark, fn.space_residues, ["ACD", "A", ""]) == ["A C D", "A", ""]
    assert values(spark, fn.placeholder_residues, ["AC"]) == ["A#C#"]
    assert values(spark, fn.pair_tokens, ["A#C#", ""]) == [["A#", "C#"], []]
    with pytest.raises(Exception, match="odd token text length"):
        values(spark, fn.pair_tokens, ["A#C"])


def reference_windows(length, size, overlap):
    spans, start = [], 0
    while True:
        end = start + size
        if end >= length:
            return spans + [(max(0, length - size), length)]
        spans.append((start, end))
        start += size - overlap


@pytest.mark.parametrize("size,overlap", [(10, 0), (10, 3), (7, 6), (1, 0)])
def test_windows_cover_and_weights_add_up(spark, size, overlap):
    rows = spark.range(0, 5 * size + 9).select(F.col("id").cast("int").alias("n"))
    wins = fn.windows(F.col("n"), size, overlap)
    for row in rows.select("n", wins.alias("w"), fn.coverage_weights(wins).alias("c")).collect():
        assert [tuple(w) for w in row.w] == reference_windows(row.n, size, overlap)
        assert all(c >= 1 for c in row.c)
        if row.n:
            assert sum(row.c) == row.n


def test_windowed_text_is_the_text(spark):
    text = "añb𝄞cdefghijklmno"
    row = spark.createDataFrame([(text,)], "s string").select(fn.windowed_text(F.col("s"), F.length("s"), 5, 2).alias("w")).first()
    chars = list(text)
    assert [w.text for w in row.w] == ["".join(chars[a:b]) for a, b in reference_windows(len(chars), 5, 2)]


def test_window_parameters_are_checked():
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            fn.check_window(size, overlap)
    with pytest.raises(ValueError):
        fn.effective_len(F.lit(1), 5, "other")


def test_identifiers(spark):
    assert values(spark, fn.uniprot_like, ["P12345", "p12345", "A0A1B2C3D4", " Q9ABC1 ", ""]) == ["P12345", None, "A0A1B2C3D4", "Q9ABC1", None]
    assert values(spark, fn.afdb_like, ["AF-P1-F1", "AF-P1", None]) == ["AF-P1-F1", None, None]
    assert values(spark, fn.genbank_like, ["NC_001.1", "MN12345.1", "ABC12345.2", "MN123.1"]) == ["NC_001.1", "MN12345.1", "ABC12345.2", None]
    assert values(spark, fn.family_id, ["PHROG_0012", "phrog_x", None]) == ["0012", None, None]
    assert values(spark, fn.archive_name, ["12", None]) == ["phrog_00012.tar.gz", None]


def test_cleaning(spark):
    assert values(spark, fn.clean, [None, " ", "NaN", " x "]) == [None, None, None, "x"]
    assert values(spark, fn.norm_format, [None, "", "mmCIF", "PDB", "BCIF"]) == ["cif", "cif", "cif", "pdb", "bcif"]
    assert values(spark, fn.to_num, [None, "x", "nan", "2.5"]) == [-1.0, -1.0, -1.0, 2.5]
    assert values(spark, lambda c: fn.priority(c, {"a": 0, "b": 1}), ["b", "z", None]) == [1, 999, 999]


def test_structure_text(spark):
    ok = lambda text, fmt: spark.range(1).select(fn.structure_text_ok(F.lit(text), F.lit(fmt))).first()[0]
    assert ok("\n data_1", "cif") and not ok("HEADER", "cif")
    assert ok("HEADER", "pdb") and ok("x\nATOM", None) and ok(" MODEL 1", "pdb") and not ok("data_1", "pdb")


def test_vectors(spark):
    p = values(spark, fn.softmax, [[1.0, 2.0, 3.0], [1000.0, 1000.0]], "array<double>")
    assert all(abs(sum(row) - 1) < 1e-12 for row in p) and p[1] == [0.5, 0.5]
    mask = F.array(F.lit(True), F.lit(False))
    assert values(spark, lambda c: fn.masked_softmax(c, mask), [[1.0, 9.0]], "array<double>") == [[1.0, 0.0]]
    assert values(spark, fn.vector_ok, [[0.0, 0.0], [0.0, 1.0], [float("nan"), 1.0], [float("inf")], None], "array<double>") == [False, True, False, False, False]
    assert values(spark, fn.argmax, [[1.0, 3.0, 3.0]], "array<double>") == [1]
    top = values(spark, lambda c: fn.topk(c, 2), [[0.1, 0.5, 0.5]], "array<double>")[0]
    assert [(t.idx, t.score) for t in top] == [(1, 0.5), (2, 0.5)]


def test_adjacency_is_symmetric_and_inside_the_mask(spark):
    for mask in ([True] * 9, [False, False, True, True, True, False, False, False, False]):
        col = F.array(*[F.lit(m) for m in mask])
        a = spark.range(1).select(fn.chain_star_adjacency(col, 4)).first()[0]
        b = spark.range(1).select(fn.chain_star_rows([F.lit(m) for m in mask], 4)).first()[0]
        assert a == b
        for i in range(9):
            for j in range(9):
                linked = mask[i] and mask[j] and i != j and (abs(i - j) == 1 or 4 in (i, j))
                assert a[i][j] == a[j][i] == float(linked)


def test_payload_shapes(spark):
    inputs = [
        '{"results": [{"a": 1}, 3], "data": [{"b": 1}]}', '[{"a": 1}, "x", {"b": 2}]', '{"a": 1}', '{"other": [1]}',
        '{"results": {"a": 1}}', "not json", None,
    ]
    assert values(spark, lambda c: F.size(fn.flatten_payload(c)), inputs) == [1, 2, 1, 0, 1, 0, 0]


def test_payload_hit_fallbacks(spark):
    rows = ['{"record_id": "", "uniq_id": "u1", "genbank_id": "g", "esmfold_log_pLDDT": 0, "colabfold_json_pLDDT": 80.5}']
    hit = values(spark, lambda c: fn.payload_to_hit(fn.flatten_payload(c)[0], "Viro3D", "http://h/"), rows)[0]
    assert (hit.source_model_id, hit.source_accession, hit.confidence_score) == ("u1", "g", 80.5)
    assert hit.cif_url == "http://h/zip/u1/genbank_id/cif"
    afdb = values(spark, lambda c: fn.payload_to_hit(fn.flatten_payload(c)[0], "AFDB"), ['[{"entryId": "AF-1", "pdbUrl": "p"}]'])[0]
    assert (afdb.source_model_id, afdb.preferred_format, afdb.cif_url, afdb.pdb_url) == ("AF-1", "pdb", None, "p")


def test_payload_hit_keeps_a_zero_score(spark):
    rows = ['{"uniq_id": "u", "colabfold_json_pLDDT": 0.0}', '{"uniq_id": "u", "esmfold_log_pLDDT": 0, "colabfold_json_pLDDT": 0}', '{"uniq_id": "u", "esmfold_log_pLDDT": 0}']
    hits = values(spark, lambda c: fn.payload_to_hit(fn.flatten_payload(c)[0], "Viro3D"), rows)
    assert [h.confidence_score for h in hits] == [0.0, 0.0, None]


def test_topk_scores_round_like_printf(spark):
    nan, inf = float("nan"), float("inf")
    rows = [[0.0078125, 0.0234375, -0.0000001], [0.1234565, nan, inf], [None, 0.5, -2.0], [None, None], [], None]
    texts = values(spark, lambda c: fn.topk_scores(fn.topk(c, 3)), rows, "array<double>")
    assert texts == ["0.023438,0.007812,-0.000000", "nan,inf,0.123456", "0.500000,-2.000000", "", "", None]
    places = values(spark, lambda c: fn.topk_indices(fn.topk(c, 3)), rows, "array<double>")
    assert places == ["1,0,2", "1,2,0", "1,2,0", "0,1", "", None]


def test_array_codec(spark):
    assert values(spark, lambda c: fn.decode_array(fn.encode_array(c), 2), [[1.5, 2.0]], "array<double>") == [[1.5, 2.0]]
    with pytest.raises(Exception, match="expected 3 elements"):
        values(spark, lambda c: fn.decode_array(c, 3), ["[1.0]"])
