import ast
import os

import corpus_pipeline
from pyspark.sql import functions as F

from folio.llm import decontaminate, language
from tests.llm.test_nearcopies import brute

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = spark.createDataFrame(
        [(10**6, None, "en", "p", 0), (10**6 + 1, "12 34 -- !!", "en", "p", 9), (10**6 + 2, docs.orderBy("doc_id").first().text, "en", "p", 1)], docs.schema
    )
    docs = docs.unionByName(planted).withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("x")).withColumn("row", F.lit(2))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "language":
            gone = {r.doc_id for r in docs.join(after, "doc_id", "left_anti").collect()}
            assert gone == {r.doc_id for r in docs.collect() if not any(c.isalpha() for c in r.text or "")}
        if name == "near_duplicates":
            gone = brute([(r.doc_id, r.text) for r in docs.collect()])
            assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in after.collect()} == set(gone) and gone
        if name == "decontamination":
            leaked = {r.doc_id for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in after.collect()} == leaked
        docs = after
    assert docs.where("not same").count() == 0 and docs.count() > 100


def test_null_ids_repeats_and_empty_tables(spark):
    rows = [(1, "some text here", "en", "s", 1), (1, "some text here", "en", "s", 1), (None, "other words again", "en", "s", 1), (None, None, None, None, None), (2, "some text here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(str(r.text) for r in kept.collect()) == ["None", "other words again", "some text here"]
    other = docs.unionByName(spark.createDataFrame([(1, "the same id but another text", "en", "s", 1)], docs.schema))
    assert corpus_pipeline.drop_near_duplicates(spark, other, SF).count() == 4
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    leak = docs.unionByName(spark.createDataFrame([(None, f"So it goes. {item}", "en", "s", 1)], docs.schema))
    assert corpus_pipeline.drop_leaks(spark, leak, SF).count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        stage(spark, docs, SF).count()


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for folder, _, names in os.walk(os.path.join(root, "folio")):
        if os.path.join("folio", "llm") in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                tree = ast.parse(open(os.path.join(folder, name)).read())
                imported = [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
                assert not any(m.startswith("folio.llm") for m in imported), name
    assert language.PROFILE == 300
