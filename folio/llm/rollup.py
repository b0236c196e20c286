"""Token counts kept up to date by signed deltas.

Facts are (source, lang, version, docs, tokens): an insert counts +1 document and its tokens, a delete
the same with a minus, a revision 0 documents and the difference. A batch of deltas is summed by
key and committed under its id; a batch that is committed already is left alone, so a
replay changes nothing. Totals add up the batches; compact() folds them into one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import bounded_batches, byte_values, documents, materialize, scratch_path
from folio.llm.tokens import WordIds

KEYS = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, docs long, tokens long"
#: A file in a batch's folder, written last: the batch counts.
MARK = "_COMMITTED"


def inserts(facts: DataFrame, tokens: str = "tokens", rows: str | None = None) -> DataFrame:
    """Deltas of new documents: columns source, lang, version and a count. A null count counts as 0; null keys are a group.

    rows: a column with how many such documents a row stands for; otherwise one.
    """
    n = (F.col(rows) if rows else F.lit(1)).cast("long")
    return facts.select(*KEYS, n.alias("docs"), (n * F.coalesce(F.col(tokens), F.lit(0))).cast("long").alias("tokens"))


def deletes(facts: DataFrame, tokens: str = "tokens", rows: str | None = None) -> DataFrame:
    """Deltas of documents that go."""
    return inserts(facts, tokens, rows).withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")})


def revisions(facts: DataFrame, before: str, after: str) -> DataFrame:
    """Deltas of documents whose count is another now."""
    change = F.coalesce(F.col(after), F.lit(0)) - F.coalesce(F.col(before), F.lit(0))
    return facts.select(*KEYS, F.lit(0).cast("long").alias("docs"), change.cast("long").alias("tokens"))


class Rollup:
    """Totals by source, language and tokenizer version in a folder, with idempotent batch commits."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def committed(self, batch: str) -> bool:
        fs, place = self._fs(f"{self.path}/batch={batch}/{MARK}")
        return fs.exists(place)

    def commit(self, batch: str, *deltas: DataFrame) -> bool:
        """Adds the deltas under this batch id; False, and no change, if the batch is there already.

        What a failed commit has left is overwritten. An empty batch is committed too. One writer at a time.
        """
        if self.committed(batch):
            return False
        rows = deltas[0]
        for more in deltas[1:]:
            rows = rows.unionByName(more)
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.where("docs != 0 or tokens != 0").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        fs, place = self._fs(f"{self.path}/batch={batch}/{MARK}")
        fs.create(place).close()
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) of all committed batches; keys that have come to nothing are left out."""
        fs, place = self._fs(self.path)
        folders = [str(x.getPath()) for x in fs.listStatus(place)] if fs.exists(place) else []
        folders = [x for x in folders if self.committed(x.rpartition("batch=")[2])]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*folders)
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs != 0 or tokens != 0")

    def compact(self, path: str) -> Rollup:
        """A rollup in another folder with the same totals in one batch, `base`. Batch ids of this one aren't known there."""
        new = Rollup(self.spark, path)
        new.commit("base", self.totals())
        return new


_coders: dict = {}


def token_counts(docs: DataFrame, words: str, pieces: str, text_col: str = "text") -> DataFrame:
    """(source, lang, hash, words, pieces): the tokens of each whole text by two tokenizers, a tokenizers and a sentencepiece file. Null texts are empty."""

    def run(batches):
        import sentencepiece

        if (words, pieces) not in _coders:
            _coders[words, pieces] = WordIds(words), sentencepiece.SentencePieceProcessor(model_file=pieces)
        coder, model = _coders[words, pieces]
        for batch in batches:
            texts = byte_values(batch.column(3))
            counts = [len(coder.encode(x)) // coder.width for x in texts], [len(model.encode(x.decode())) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(x, pa.int64()) for x in counts)], names=["source", "lang", "hash", "words", "pieces"])

    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.sha2(text, 256).alias("hash"), text.alias("text"))
    return rows.mapInArrow(run, "source string, lang string, hash string, words long, pieces long")


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after four batches over all documents.

    first: inserts of every row's tokens by word_bpe_49k; repeats: deletes of all but one row of each text (the one with the least source and
    language stays; nulls come first); recount: what is left has an end token too; pieces: inserts of the same documents under a second
    version, piece_bpe_32k. The second batch is committed twice. Null and repeated ids don't matter, as rows are told apart by their text alone.
    """
    import public_tokenizers

    names = "word_bpe_49k", "piece_bpe_32k"
    counts = token_counts(documents(spark, sf_dir), public_tokenizers.path(f"{names[0]}.json"), public_tokenizers.path(f"{names[1]}.model"))
    # rows of one text, source and language are one row with their number, so the copies of a text never meet in one task
    facts = counts.groupBy("hash", "source", "lang").agg(F.first("words").alias("words"), F.first("pieces").alias("pieces"), F.count("*").alias("n"))
    facts = materialize(facts, "facts").withColumn("version", F.lit(names[0]))
    # a text has as many rows now as sources and languages
    kept = facts.groupBy("hash").agg(F.min_by(F.struct(*KEYS, "words", "pieces"), F.struct("source", "lang")).alias("x")).select("x.*").withColumn("ended", F.col("words") + 1)
    rollup = Rollup(spark, scratch_path(spark, "rollup"))
    repeats = deletes(facts, "words", "n"), inserts(kept, "words")
    rollup.commit("first", inserts(facts, "words", "n"))
    rollup.commit("repeats", *repeats)
    rollup.commit("recount", revisions(kept, "words", "ended"))
    rollup.commit("pieces", inserts(kept.withColumn("version", F.lit(names[1])), "pieces"))
    rollup.commit("repeats", *repeats)
    return rollup.totals()
