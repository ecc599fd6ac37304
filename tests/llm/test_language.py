"""Languages on held-out rows and edge cases."""


from partslake.llm import language as L

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", docs_extra())
    out = L.language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out and r.lang is not None]
    assert len(out) == docs.count() and len(held) > 20
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 for r in out)


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_edge_rows(spark, rows):
    data = [(i, "the cat and the dog", "en") for i in range(8)] + [(i, "der hund und die katze", "de") for i in range(8, 16)]
    data += [(20, None, "en"), (21, "", None), (22, "123 -- 45", "de"), (23, "z", None), (None, "und die katze", None), (24, "the dog " * 200_000, None), (24, "the dog " * 200_000, None)]
    out = L.language(rows(data, "doc_id long, text string, lang string"), fold=None).collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r)
    assert len(out) == len(data)
    assert all(got[i][0].lang_pred == "und" and got[i][0].score == 0 for i in (20, 21, 22))
    assert got[23][0].lang_pred in ("en", "de") and got[None][0].lang_pred == "de" and [r.lang_pred for r in got[24]] == ["en", "en"]


def test_nothing_to_learn(spark, rows):
    empty = rows([], "doc_id long, text string, lang string")
    assert L.language(empty).count() == 0
    assert [r.lang_pred for r in L.language(rows([(1, "abc", None)], "doc_id long, text string, lang string")).collect()] == ["und"]


def test_far_text_is_rejected(spark, rows):
    data = [(i, f"the cat and the dog number {i}", "en") for i in range(40)] + [(99, "Жук жужжит над жёлтым", None)]
    out = {r.doc_id: r for r in L.language(rows(data, "doc_id long, text string, lang string"), fold=None).collect()}
    assert out[99].rejected and sum(out[i].rejected for i in range(40)) <= 2


