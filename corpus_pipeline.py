"""The corpus pipeline over documents.

Toxic documents go, then those without a recognised language, then all but one of each group of near
duplicates, then those that leak benchmark items; what is left is encoded. Every stage works on all
rows that the one before has kept.

Rows are told apart by doc_id; where one is null or comes more than once, by their place in the stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import decontaminate, language, nearcopies, pieces, simhash, toxicity
from folio.llm.common import clear_scratch, materialize, scratch_path

#: Mean out-of-place score below which a prediction is no more than chance.
LEAST_LANGUAGE_SCORE = 0.15


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many _ in front as it takes to be new."""
    while name in df.columns:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that aren't predicted toxic; null and empty texts are scored like others."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    row = F.struct(*[f"`{c}`" for c in docs.columns]).alias("row")
    return toxicity.score(docs.select(row, "text"), model, keep_text=False).where("predicted = 0").select("row.*")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled ones have; without a letter, or unlike all of them, they go."""
    profiles = language.train_profiles(docs, F.lit(True))
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    told = language.identify(docs, profiles, names=(lang, score))
    return told.where((F.col(lang) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def told_apart(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and the name of a column that tells its rows apart: doc_id, or the place of a row if some doc_id is null or repeated."""
    repeated = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not repeated:
        return docs, "doc_id"
    row = fresh(docs, "row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates: texts that share 0.8 or more of their five-word shingles.

    SimHash groups propose pairs, and so do minhash keys, as SimHash at a few bits doesn't reach 0.8; the shingles decide.
    """
    rows, key = told_apart(docs)
    gone = nearcopies.groups(rows, key, "text", [simhash.near_duplicates(rows, key)])
    gone = materialize(gone.select(F.col("node").alias(key)), "copies")
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item."""
    rows, key = told_apart(docs)
    leaks = decontaminate.find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key, item_col="item_id")
    gone = materialize(leaks.select(key).distinct(), "leaked")
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The other columns of docs, and ids (little-endian uint32) and n_tokens of each text, and whether they decode to it.

    Columns of the names ids, n_tokens, same and decoded_sha256 are replaced.
    """
    return pieces.encode(docs, pieces.model_path(), held=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pieces", encode),
]

#: Boosted trees and merge ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again.

    What a stage has left there goes when its rows are written, so other queries' tables made in this process before go too.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        clear_scratch(spark, [path])
    return docs
