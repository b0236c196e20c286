"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration.

The labelled rows that may be learnt from are cut in three by a hash of the id: one part gives the
lexicon (words and word beginnings that toxic texts favour, besides a short fixed list), one
trains the trees, one calibrates. So neither the trees nor the calibration see densities that
were fitted to their own rows. Equal texts count once for the lexicon.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import chunks, documents, fold, materialize

#: About so many labelled rows are learnt from at most; with more, a hash of the id picks them.
TRAIN_ROWS = 24_000
#: Terms that a task counts before it hands them on, and characters that it turns into features together.
TERMS_KEPT = 100_000
AT_ONCE = 2_000_000
#: Learnt lexicon entries.
LEXICON = 500
BEGINNINGS = (4, 5, 6)
NEAR = 5  # words
TREES, DEPTH, STEP = 24, 3, 0.25
SEED_WORDS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting trash scum clown fool imbecile jerk bastard bitch asshole crap shit fuck fucking "
    "hate ugly filthy vermin garbage shut idiota imbécil estúpido estúpida basura asqueroso connard salope merde débile abruti dumm idioten blöd arschloch scheiße abschaum".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur tu te ti toi vous votre ton ta tes du dich dir dein deine ihr euch usted ustedes vos tú".split())
_WORD = re.compile(r"\w+")
_OBFUSCATED = re.compile(r"[0-9@$*!][a-z]")  # a sign that goes on as a letter
_PLAIN = str.maketrans("013457@$!", "oieastasi")
FEATURES = (
    "seed_density", "seed_hits", "learnt_density", "learnt_hits", "learnt_most", "start_density", "start_hits", "near_density",
    "person_density", "capitals", "punctuation", "exclamation", "obfuscation", "obfuscated_hits", "words", "repetition",
)


def _solved(word: str, words: dict[str, float]) -> bool:
    """Whether a word with signs for letters can be read as one of the lexicon; a * is any letter."""
    read = {word.translate(_PLAIN), word.rstrip("!").translate(_PLAIN)}
    if any(w in SEED_WORDS or w in words for w in read):
        return True
    fits = lambda a, b: len(a) == len(b) and all(x in ("*", y) for x, y in zip(a, b, strict=True))
    return "*" in word and any(fits(w, b) for w in read for b in SEED_WORDS)


_NAMES = [f"f{i}" for i in range(len(FEATURES))]


def features(text: str, words: dict[str, float], starts: dict[str, float]) -> list[float]:
    """The FEATURES of a text; an empty one has zeros."""
    low = text.lower()
    tokens = _WORD.findall(low)
    n = max(1, len(tokens))
    seed = [i for i, w in enumerate(tokens) if w in SEED_WORDS]
    learnt = [words[w] for w in tokens if w in words]
    begun = [max(found) for w in tokens if len(w) >= BEGINNINGS[0] and w[: BEGINNINGS[0]] in starts and (found := [starts[w[:k]] for k in BEGINNINGS if w[:k] in starts])] if starts else []
    person = [i for i, w in enumerate(tokens) if w in SECOND_PERSON]
    near = 0
    if person:
        hits = [i for i, w in enumerate(tokens) if w in words or w in SEED_WORDS]
        if hits:
            at = np.searchsorted(person, hits)
            p = np.array([-(10**9), *person, 10**9])
            near = int((np.minimum(np.abs(p[at] - hits), np.abs(p[at + 1] - hits)) <= NEAR).sum())
    odd = [w.strip(".,;:?()\"'") for w in low.split() if _OBFUSCATED.search(w)] if _OBFUSCATED.search(low) else []
    solved = sum(_solved(w, words) for w in odd)
    by = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    capitals, lower = int(by[65:91].sum()), int(by[97:123].sum())
    marks = int(by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum())
    return [
        100 * len(seed) / n, math.log1p(len(seed)), 100 * sum(learnt) / n, math.log1p(len(learnt)), max(learnt, default=0.0),
        100 * sum(begun) / n, math.log1p(len(begun)), 100 * near / n, 100 * len(person) / n, capitals / max(1, capitals + lower),
        marks / max(1, len(text)), 100 * int(by[33]) / n, 100 * len(odd) / n, float(solved), math.log1p(len(tokens)), len(set(tokens)) / n,
    ]


def with_features(rows: DataFrame, words: dict[str, float], starts: dict[str, float], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, f0, f1, ...): the columns of keep (None: all) as a struct, so none can clash, and the FEATURES of each text."""
    keep = rows.columns if keep is None else keep
    packed = rows.select(F.struct(*[f"`{c}`" for c in keep]).alias("row"), F.col(f"`{text_col}`").alias("text") if text_col not in keep else F.lit(None).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            own = batch.column(0).field(keep.index(text_col)) if text_col in keep else batch.column(1)
            for a, b in chunks(pc.fill_null(pc.utf8_length(own), 0).to_pylist(), AT_ONCE):
                texts = own.slice(a, b - a).to_pylist()
                made = np.array([features(x or "", words, starts) for x in texts], np.float64).reshape(len(texts), len(FEATURES))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(made[:, i]) for i in range(len(FEATURES)))], names=["row", *_NAMES])

    return packed.mapInArrow(run, T.StructType([packed.schema["row"], *(T.StructField(n, T.DoubleType()) for n in _NAMES)]))


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, toxic, docs, times) of columns text and toxic; beginnings of words have a * behind."""

    def run(batches):
        docs: Counter = Counter()
        times: Counter = Counter()

        def flush():
            terms, kinds = zip(*docs, strict=True)
            out = [pa.array(terms, pa.string()), pa.array(kinds, pa.int32()), pa.array(list(docs.values()), pa.int64()), pa.array([times[x] for x in docs], pa.int64())]
            docs.clear()
            times.clear()
            return pa.RecordBatch.from_arrays(out, names=["term", "toxic", "docs", "times"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: Counter = Counter()
                for word, n in Counter(_WORD.findall((text or "").lower())).items():
                    own[word] += n
                    for k in BEGINNINGS:
                        if len(word) >= k:
                            own[word[:k] + "*"] += n
                for term, n in own.items():
                    docs[term, toxic] += 1
                    times[term, toxic] += n
                if len(docs) > TERMS_KEPT:
                    yield flush()
        if docs:
            yield flush()

    return rows.select("text", "toxic").mapInArrow(run, "term string, toxic int, docs long, times long")


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> tuple[dict[str, float], dict[str, float]]:
    """({word: log odds}, {beginning: log odds}) of terms that several toxic texts share and others have less."""
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))
    toxic = rows.where("toxic = 1").count()
    if not toxic:
        return {}, {}
    by = term_counts(rows).groupBy("term")
    own = lambda c, t: F.sum(F.when(F.col("toxic") == t, F.col(c)).otherwise(0))
    counts = by.agg(own("docs", 1).alias("docs"), own("times", 1).alias("hit"), own("times", 0).alias("other"))
    totals = counts.where("term not like '%*'").agg(F.sum("hit"), F.sum("other")).first()
    odds = F.log((F.col("hit") + 0.5) / F.lit((totals[0] or 0) + 1.0)) - F.log((F.col("other") + 0.5) / F.lit((totals[1] or 0) + 1.0))
    found = counts.where(F.col("docs") >= max(3, math.ceil(toxic * 0.02))).withColumn("odds", odds).where("odds > 1.5")
    top = found.orderBy(F.desc(F.col("odds") * F.log1p("docs")), "term").limit(size).select("term", "odds").collect()
    words = {t: o for t, o in top if not t.endswith("*")}
    return words, {t[:-1]: o for t, o in top if t.endswith("*")}


@dataclass
class Model:
    """What scoring needs. Without both kinds of labels there are no trees, and the share of toxic rows is the score."""

    words: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)
    trees: object = None
    steps: object = None
    prior: float = 0.0


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=_NAMES, outputCol="_features").transform(rows)


def train(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> Model:
    """Learns from labelled rows that meet `use` (a condition on the id column); null labels, ids and texts are left out.

    A row with several labels is toxic if one of them says so. About `most` rows are used.
    """
    own = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & use).groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic"))
    every = -(-own.count() // most)
    if every > 1:
        own = own.where(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0)
    texts = docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(own), id_col).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), F.col(id_col)), F.lit(10)))
    rows = materialize(rows, "labelled")
    words, starts = learn_lexicon(rows.where("part < 4"))
    made = with_features(rows.where("part >= 4"), words, starts, keep=["toxic", "part"]).select("row.*", *_NAMES)
    made = _assembled(materialize(made, "features").coalesce(8).withColumn("label", F.col("toxic").cast("double")))
    kinds = dict(made.where("part < 8").groupBy("toxic").count().collect())
    prior = rows.agg(F.avg("toxic")).first()[0] or 0.0
    if len(kinds) < 2:
        return Model(words, starts, prior=prior)
    trees = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=64, seed=7).fit(made.where("part < 8").select("_features", "label"))
    scored = trees.transform(made.where("part >= 8")).select(vector_to_array("probability")[1].alias("p"), "label")
    steps = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="_score").fit(scored) if len(scored.select("label").distinct().take(2)) == 2 else None
    return Model(words, starts, trees, steps, prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs and score (0 to 1) and predicted (1 if score >= 0.5). Null and empty texts are scored as such; rows stay whole."""
    kept = [c for c in docs.columns if c not in ("score", "predicted") and (keep_text or c != text_col)]
    if model.trees is None:
        rows = docs.select(*[f"`{c}`" for c in kept], F.lit(float(model.prior)).alias("score"))
    else:
        rows = model.trees.transform(_assembled(with_features(docs, model.words, model.starts, text_col, kept)))
        rows = rows.select("row", vector_to_array("probability")[1].alias("p"))
        rows = model.steps.transform(rows) if model.steps is not None else rows.withColumn("_score", F.col("p"))
        rows = rows.select("row.*", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_score")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learnt where crc32(doc_id) mod 5 isn't 0."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 5) != 0)
    found = score(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
