import unicodedata

import zstandard
from pyspark.sql import functions as F

from harborline.llm import language_id
from harborline.llm.queries import op1_language_id

ROOT = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    found = op1_language_id(spark, ROOT)
    assert found.count() == docs.count()
    held = found.where("held_out").join(docs, "doc_id")
    assert held.where("n > 40").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert found.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    assert held.where("rejected").count() < 0.02 * held.count()


def test_odd_texts_and_clashing_columns(spark):
    train = [(w, lang) for lang, w in (("xx", "lorem ipsum dolor sit amet " * 30), ("yy", "qwert zuiop asdfg hjkly " * 30))] + [("no label", None), (None, "xx")]
    model = language_id.learn(spark.createDataFrame(train, "text string, lang string"))
    assert [m[0] for m in model] == ["xx", "yy"]
    texts = [None, "", "123 !? \n", "LOREM ipsum 12 Dolor", "asdfg hjkly", "ipsum " * 50000, "\U0001d11e ñ"]
    rows = [(i, t, "old", 1.5) for i, t in enumerate(texts)] + [(3, "LOREM ipsum 12 Dolor", "old", 1.5)]
    found = language_id.detect(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double"), model).collect()
    assert [(r.lang_pred, r.rejected) for r in found[:6]] == [("und", True)] * 3 + [("xx", False), ("yy", False), ("xx", False)]
    assert found[6].lang_pred in ("xx", "yy") and found[6].rejected and found[7][1:] == found[3][1:]


def plain_prediction(text, model):
    """Every piece compressed by a compressor of its own, with nothing prepared."""
    letters = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower())
    content = " ".join(letters.split()).encode()
    if not content:
        return "und", 0.0
    sizes = []
    for _, words in model:
        known = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(
            3, dict_size=len(words), source_size=language_id.PIECE_BYTES, min_match=4, write_content_size=0, write_checksum=0,
            write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        size = 0
        for i in range(0, len(content), language_id.PIECE_BYTES):
            size += len(zstandard.ZstdCompressor(dict_data=known, compression_params=how).compress(content[i : i + language_id.PIECE_BYTES]))
        sizes.append(size)
    first, second = sorted(sizes)[:2]
    return model[sizes.index(first)][0], 1 - first / second


def test_query_equals_a_plain_version(spark):
    """All held-out rows of the small table, and the model from the rows that are not held out."""
    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.learn(docs.where(~held).select("lang", "text"))
    found = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in op1_language_id(spark, root).collect()}
    rows = docs.select("doc_id", "text", held.alias("held")).collect()
    for r in [r for r in rows if r.held and len(r.text or "") < 20_000][:60]:
        lang, score = plain_prediction(r.text, model)
        assert found[r.doc_id][:2] == (True, lang) and abs(found[r.doc_id][2] - score) < 1e-12


def test_numbers_that_are_no_digits_are_no_letters(spark):
    """One notion of a letter: superscripts, fractions and numerals in circles are none, marks and CJK as Unicode says."""
    model = [("en", b"some words"), ("de", b"einige worte")]
    texts = ["²", "½", "①", "Ⅷ", "_", "٣", "a", "字", "ª"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.lang_pred == "und" for r in language_id.detect(rows, model).collect()}
    assert found == {i: unicodedata.category(t)[0] != "L" for i, t in enumerate(texts)}
    taught = rows.withColumn("lang", F.col("text"))
    assert sorted(m[0] for m in language_id.learn(taught)) == ["a", "ª", "字"]


def test_clashing_names_in_any_case(spark):
    rows = spark.createDataFrame([(1, "abc", 5, "x")], "doc_id long, Text string, SCORE int, Lang_Pred string")
    found = language_id.detect(rows, [("en", b"abc"), ("de", b"xyz")])
    assert found.columns == ["doc_id", "Text", "lang_pred", "score", "rejected"] and found.first()["lang_pred"] == "en"


def test_empty_tables(spark):
    kind = "doc_id long, text string, lang string"
    model = language_id.learn(spark.createDataFrame([], kind))
    assert model == [] and language_id.detect(spark.createDataFrame([], kind), model).count() == 0
    assert language_id.detect(spark.createDataFrame([(1, "abc", None)], kind), model).first().lang_pred == "und"
