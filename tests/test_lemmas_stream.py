"""T5 lemma lookup and the streaming harvest."""

import os

from themelens.operators.lemmas import lemmatize
from themelens.streaming import run_to_completion

LEMMAS = [("casas", "casa", "NOUN"), ("são", "ser", "AUX"), ("et", "et", "PUNCT"), ("x", "x", "SYM")]


def _docs(spark):
    return spark.createDataFrame([(1, "as casas são 12 bonitas. et x"), (2, "..."), (3, None)],
                                 "doc_id long, t string")


def test_lemmatize(spark):
    lem = spark.createDataFrame(LEMMAS, "surface string, lemma string, pos string")
    got = {r.doc_id: r.o for r in lemmatize(_docs(spark), lem, "t", "o").collect()}
    assert got == {1: "as casa ser bonitas", 2: "", 3: ""}


def test_lemmatize_nulls_and_repeats(spark):
    """A null lemma leaves the surface, a null pos the default tag; repeats take the smallest (pos, lemma)."""
    lem = spark.createDataFrame([("casas", None, "NOUN"), ("são", "ser", None), (None, "y", "X"), ("12", "doze", None),
                                 ("bonitas", "b2", "X"), ("bonitas", "b1", "X"), ("bonitas", "b0", "Y")],
                                "surface string, lemma string, pos string")
    got = {r.doc_id: r.o for r in lemmatize(_docs(spark), lem, "t", "o").collect()}
    assert got == {1: "as casas ser b1 et x", 2: "", 3: ""}


PAD = "<!-- " + "x" * 100 + " -->"


def test_stream_dedupes_across_batches(spark, tmp_path):
    src = tmp_path / "pages"
    out = str(tmp_path / "records")
    a = spark.createDataFrame([(1, "https://h.org/a", "<title>A</title>" + PAD), (2, "https://h.org/b", "<title>B</title>" + PAD)],
                              "page_id long, url string, html string")
    a.write.parquet(str(src / "batch1"))
    ckpt = str(tmp_path / "ckpt")
    run_to_completion(spark, str(src / "batch1"), out, checkpoint=ckpt)
    # the same URL again plus a new one, in a second run from another folder
    b = spark.createDataFrame([(3, "https://h.org/a", "<title>A2</title>" + PAD), (4, "https://h.org/c", "<title>C</title>" + PAD)],
                              "page_id long, url string, html string")
    b.write.parquet(str(src / "batch2"))
    res = run_to_completion(spark, str(src / "batch2"), out, checkpoint=str(tmp_path / "ckpt2"))
    got = sorted((r.link_acesso, r.titulo) for r in res.collect())
    assert got == [("https://h.org/a", "A"), ("https://h.org/b", "B"), ("https://h.org/c", "C")]
    assert os.path.isdir(out)


def test_stream_records_of_a_file_and_of_a_folder(spark, tmp_path):
    """The page table may be one parquet file or a folder of part files."""
    import glob
    import shutil

    from themelens.plans import QUERIES
    rows = [(i, f"https://h.org/{i}", f"<title>T{i}</title>" + PAD) for i in range(4)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).write.parquet(str(tmp_path / "many" / "pages.parquet"))
    one = tmp_path / "one"
    one.mkdir()
    spark.read.parquet(str(tmp_path / "many" / "pages.parquet")).coalesce(1).write.parquet(str(tmp_path / "part"))
    shutil.copy(glob.glob(str(tmp_path / "part" / "part-*.parquet"))[0], one / "pages.parquet")
    for at in ("many", "one"):
        got = sorted(tuple(r) for r in QUERIES["stream_records"](spark, str(tmp_path / at)).collect())
        assert got == [(i, f"T{i}", f"https://h.org/{i}") for i in range(4)]


def test_lookup_and_join_give_the_same(spark, monkeypatch):
    """Inside the row without a shuffle of tokens, or joined with a table too large for that: the same rows."""
    from themelens.operators import lemmas
    lem = spark.createDataFrame(LEMMAS + [("a", None, "X"), ("b", "", "X"), ("12", "doze", None), ("..", "pp", "X"), (None, "y", "X")],
                                "surface string, lemma string, pos string")
    rows = [(1, "as casas são 12 bonitas. et x .. ..."), (1, "b casas as a 12 \u4e00 \u00bd2 \u2167 x1"), (2, None), (2, "zz_ 3"), (3, "..."),
            (None, "as casas"), (4, "um b dois")]
    docs = spark.createDataFrame(rows, "doc_id long, t string")

    def result():
        out = lemmatize(docs, lem, "t", "o")
        return out._jdf.queryExecution().toString(), sorted(map(tuple, out.collect()), key=repr)

    plan, got = result()
    assert "posexplode" not in plan
    monkeypatch.setattr(lemmas, "INLINE_LEMMAS", 0)
    plan, want = result()
    assert "posexplode" in plan and got == want
