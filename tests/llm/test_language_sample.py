from pyspark.sql import functions as F

from folio.llm import language


def test_small_languages_are_used_whole(spark):
    rows = [(i, "hot text of one kind", "aa") for i in range(3000)] + [(3000 + i, "zzz", "bb") for i in range(3)] + [(4000 + i, "qqq" if i else "xyz", "cc") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    whole = language.gram_counts

    def spy(labelled):
        seen.update({r[0]: r[1] for r in labelled.groupBy("lang").count().collect()})
        return whole(labelled)

    language.gram_counts = spy
    try:
        profiles = language.train_profiles(docs, F.lit(True), most=300)
    finally:
        language.gram_counts = whole
    assert seen["bb"] == 3 and seen["cc"] == 40 and 180 < seen["aa"] < 340
    assert set(profiles) == {"aa", "bb", "cc"} and "xyz" in profiles["cc"]
    assert language.train_profiles(docs.limit(0), F.lit(True), most=300) == {}
