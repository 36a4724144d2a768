"""A language of a small share of the corpus, and one that only pages declare, have models."""

from skein.llm import corpus_queries, language_id


def test_rare_languages(spark, tmp_path):
    russian, greek = "дом и сад в городе у реки", "το σπίτι και ο κήπος στην πόλη"
    docs = [(i, f"the house and the garden of number {i} in the town", "en", "a") for i in range(7000)] + [(8000 + i, russian, " RU", "a") for i in range(21)] + [(9000 + i, "the house", "xx", "a") for i in range(3)]
    pages = [(i, f"http://a.example.com/{i}", f"<html lang=el><p>{greek}</p></html>") for i in range(25)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = corpus_queries.op1_language_id(spark, str(tmp_path)).collect()
    rare = [r for r in found if r.id_declared in ("ru", "el")]
    assert len(rare) == 46 and all(r.id_accepted and r.id_lang == r.id_declared == r.id_text_lang for r in rare)
    assert {r.id_lang for r in found} == {"en", "ru", "el"}  # three records make no language
    assert language_id.keep_identified(docs).where("doc_id >= 8000").count() == 24


def test_fit_is_bounded(spark):
    docs = spark.createDataFrame([(f"the house {i}", "en") for i in range(4000)] + [(f"das haus {i}", "de") for i in range(30)], "text string, declared string")
    assert language_id.fit_text(docs, rows=200).languages == ["de", "en"]
    assert language_id.fit_text(docs.limit(0)).languages == []
