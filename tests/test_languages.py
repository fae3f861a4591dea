import random

import opinarium as op
from catalog.views import load
from opinarium.functions import edges

SF = "/root/testdata/sf0.01"


def test_held_out_documents_beat_the_word_lists(spark):
    docs = load(spark, SF, "documents")
    model = op.learn_languages(docs.filter("doc_id % 5 <> 0"))
    held_out = docs.filter("doc_id % 5 = 0")
    right = op.detect_by_edges(held_out, model).filter("detected = lang").count()
    listed = op.detect_language(held_out).filter("detected = lang").count()
    assert right >= listed and right >= 0.98 * held_out.count()


def test_short_texts(spark):
    """Single words of held-out documents, of which word lists know few."""
    docs = load(spark, SF, "documents")
    model = op.learn_languages(docs.filter("doc_id % 5 <> 0"))
    rng = random.Random(2)
    rows = []
    for r in docs.filter("doc_id % 5 = 0").select("text", "lang").collect():
        words = (r.text or "").split()
        if len(words) > 12:
            at = rng.randrange(len(words) - 5)
            rows.append((" ".join(words[at : at + 5]), r.lang))
    df = spark.createDataFrame(rows, "text string, lang string")
    learned = op.detect_by_edges(df, model).filter("detected = lang").count()
    assert learned > op.detect_language(df).filter("detected = lang").count()


def test_by_hand(spark, tmp_path):
    labelled = spark.createDataFrame([("xa xa xa", "aa"), ("yb", "bb"), ("zz", None), (None, "cc")], "text string, lang string")
    model = op.learn_languages(labelled)
    assert model.languages == ("aa", "bb")
    op.store_languages(spark, model, str(tmp_path / "m"))
    assert op.load_languages(spark, str(tmp_path / "m")) == model
    df = spark.createDataFrame([(t,) for t in ("xa", "Yb!", "q", "", None, "12 34", "xa yb yb yb")], "text string")
    got = [r.detected for r in op.detect_by_edges(df, model).collect()]
    assert got == ["aa", "bb", "aa", None, None, None, "bb"]  # of equal scores the first language


def test_nothing_to_learn(spark):
    model = op.learn_languages(spark.createDataFrame([("a", None)], "text string, lang string"))
    assert op.detect_by_edges(spark.createDataFrame([("a",)], "text string"), model).first().detected is None
    assert len(edges.learn_languages(spark.createDataFrame([("漢字 é", "zh")], "text string, lang string")).weights[0]) == edges.CODES
