from harborline.llm.line_dedup import remove_boilerplate

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_spread_lines_stay_once(spark):
    rows = [(i, f"own line {i}\n  shared by ten \n\nshared by nine\nown end", "en", f"s{i}" if i else None, 1) for i in range(9)]
    rows += [(20, "shared by ten", "en", "s20", 13), (21, "shared by nine\nshared by nine", "en", "s1", 1), (None, "shared by ten", None, "s3", 1),
             (30, None, "en", "s1", None), (31, "", "en", "s1", 0), (32, "\n\n", "en", "s1", 2), (4, "shared by ten\nx", "en", "s4", 1), (4, "shared by ten\nx", "en", "s4", 1)]
    out = remove_boilerplate(spark.createDataFrame([(*r, 5) for r in rows], f"{KIND}, line int").repartition(4))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "line", "n_lines", "n_removed"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_removed, r.n_chars))
    assert got[0] == [("own line 0\n  shared by ten \n\nshared by nine\nown end", 5, 0, 51)]
    assert got[1] == [("own line 1\n\nshared by nine\nown end", 5, 1, 34)]
    assert got[20] == [("", 1, 1, 0)] and got[None] == [("", 1, 1, 0)]
    assert got[21] == [("shared by nine\nshared by nine", 2, 0, 29)]
    assert got[30] == [(None, 0, 0, None)] and got[31] == [("", 1, 0, 0)] and got[32] == [("\n\n", 3, 0, 2)]
    assert sorted(got[4], key=str)[-2:] == [("x", 2, 1, 1)] * 2


def test_threshold_is_exact(spark):
    rows = [(i * 100 + k, f"on {n} sites", "en", f"s{k}", 1) for i, n in enumerate(range(5, 16)) for k in range(n)]
    out = remove_boilerplate(spark.createDataFrame(rows, KIND)).collect()
    for i, n in enumerate(range(5, 16)):
        removed = sum(r.n_removed for r in out if r.doc_id // 100 == i)
        assert removed == (n - 1 if n >= 10 else 0)


def test_clashing_names_pass_through(spark):
    kinds = "doc_id long, text string, source string, text_hash int, TEXT_HASH_ int, gone string, __removed int, __text_hash int, n_lines string"
    rows = [(i, f"line\nown {i}", f"s{i}", 1, 2, "g", 3, 4, "old") for i in range(12)]
    out = remove_boilerplate(spark.createDataFrame(rows, kinds))
    assert out.columns == ["doc_id", "text", "source", "text_hash", "TEXT_HASH_", "gone", "__removed", "__text_hash", "n_lines", "n_removed"]
    got = sorted(tuple(r) for r in out.collect())
    assert got[0] == (0, "line\nown 0", "s0", 1, 2, "g", 3, 4, 2, 0) and got[5] == (5, "own 5", "s5", 1, 2, "g", 3, 4, 2, 1)


def test_empty_table(spark):
    assert remove_boilerplate(spark.createDataFrame([], KIND)).count() == 0
