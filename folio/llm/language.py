"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent letter n-grams (1 to 3 letters; words are
padded with a boundary mark), most frequent first. A document's own most frequent n-grams are
held against each profile: each n-gram adds the distance between its two ranks, or the profile
length where the profile lacks it; the language with the smallest sum is predicted.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.common import bounded_batches, chunks, documents, fold

#: N-grams of a profile.
PROFILE = 300
#: The most training documents that are used (about; chosen by a hash of the id), in equal shares of the languages that have more.
TRAIN_DOCS = 40_000
#: Characters whose n-grams are counted together; the arrays take about 100 bytes for each.
AT_ONCE = 500_000
#: Counted n-grams that a task holds.
COUNTS_KEPT = 120_000
MARK = "_"
_MARK_CODE = 1  # sorts before every letter


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])


def _spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, owner): lower-case letters of all texts with a mark around each word, and the text of each code."""
    codes, owners = [], []
    for i, text in enumerate(texts):
        x = np.frombuffer(f"\n{text.lower()}\n".encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.where(_letters()[x], x, _MARK_CODE)
        x = x[np.concatenate([[True], (x[1:] != _MARK_CODE) | (x[:-1] != _MARK_CODE)])]
        if len(x) > 1:
            codes.append(x)
            owners.append(np.full(len(x), i, np.int64))
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(codes).astype(np.int64), np.concatenate(owners)


class Grams:
    """Counted n-grams of groups of texts: group, key, count; sorted by group and key."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray):
        self.alphabet, dense = np.unique(codes, return_inverse=True)
        self.bits = max(1, int(len(self.alphabet)).bit_length())
        b, one = self.bits, dense + 1
        group = owner << 3 * b
        same = (owner[1:] == owner[:-1]) & ((codes[1:] != _MARK_CODE) | (codes[:-1] != _MARK_CODE))
        two = (one[:-1] << b) | one[1:]
        parts = [(group | one)[codes != _MARK_CODE], (group[1:] | two)[same]]
        parts.append(((one[:-2] << 2 * b) | group[2:] | two[1:])[(owner[2:] == owner[:-2]) & (codes[1:-1] != _MARK_CODE)])
        keys = np.sort(np.concatenate(parts))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.count = np.diff(np.append(first, len(keys)))
        self.group, self.key = keys[first] >> 3 * b, keys[first] & (1 << 3 * b) - 1

    def text(self, key: int) -> str:
        out = ""
        while key:
            code = int(self.alphabet[(key & (1 << self.bits) - 1) - 1])
            out, key = (MARK if code == _MARK_CODE else chr(code)) + out, key >> self.bits
        return out

    def key_of(self, gram: str) -> int:
        """The key of an n-gram, or -1 if these texts lack one of its letters."""
        key = 0
        for c in gram:
            code = _MARK_CODE if c == MARK else ord(c)
            at = int(np.searchsorted(self.alphabet, code))
            if at == len(self.alphabet) or self.alphabet[at] != code:
                return -1
            key = key << self.bits | at + 1
        return key


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) from columns lang and text, both non-null."""

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names = sorted(set(langs))
            number = {x: i for i, x in enumerate(names)}
            for a, b in chunks([len(x) for x in texts], AT_ONCE):
                codes, owner = _spans(texts[a:b])
                if not len(codes):
                    continue
                own = np.array([number[x] for x in langs[a:b]])[owner]
                order = np.argsort(own, kind="stable")  # each text begins and ends with a mark, and two marks are no n-gram
                grams = Grams(codes[order], own[order])
                for g, k, n in zip(grams.group.tolist(), grams.key.tolist(), grams.count.tolist(), strict=True):
                    total[names[g], grams.text(k)] += n
                if len(total) > COUNTS_KEPT:
                    yield _counted(total)
                    total.clear()
        if total:
            yield _counted(total)

    bounded_batches(labelled.sparkSession)
    found = labelled.select("lang", "text").mapInArrow(run, "lang string, gram string, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _counted(total: Counter) -> pa.RecordBatch:
    langs, grams = zip(*total, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(langs), pa.array(grams), pa.array(list(total.values()), pa.int64())], names=["lang", "gram", "n"])


def train_profiles(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, most: int = TRAIN_DOCS) -> dict[str, list[str]]:
    """{language: its n-grams, most frequent first}, from rows that meet `train` and have a language.

    `most` bounds the rows used (about), by language: those that have no more than an equal share of it are
    taken whole, and of the others as much each as is left, by a hash of the id.
    Ties are broken by n-gram. At most size x languages rows come to the driver.
    """
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = sorted((n, lang) for lang, n in rows.groupBy(lang_col).count().collect())
    left, keep = most, []
    for i, (n, lang) in enumerate(found):
        share = left / (len(found) - i)
        if n > share:
            keep += [F.lit(lang), F.lit(max(1, int(share / n * (1 << 30))))]
        left -= min(n, share)
    if keep:
        part = F.try_element_at(F.create_map(*keep), F.col(lang_col))
        rows = rows.where(part.isNull() | (F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < part))
    counts = gram_counts(rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= size)
    profiles: dict[str, list[str]] = {}
    for lang, gram in top.orderBy("lang", "rank").select("lang", "gram").collect():
        profiles.setdefault(lang, []).append(gram)
    return profiles


def predict(texts: list[str | None], profiles: dict[str, list[str]], size: int = PROFILE) -> list[tuple[str, float]]:
    """(language, score) of each text; und and 0 for texts without a letter, or without any profile."""
    out = [("und", 0.0)] * len(texts)
    codes, owner = _spans([x or "" for x in texts])
    if not len(codes) or not profiles:
        return out
    if len(texts) > 1 and 3 * len(np.unique(codes)).bit_length() + len(texts).bit_length() > 62:  # more than a key holds
        half = len(texts) // 2
        return predict(texts[:half], profiles, size) + predict(texts[half:], profiles, size)
    grams = Grams(codes, owner)
    order = np.lexsort((grams.key, -grams.count, grams.group))
    group, key = grams.group[order], grams.key[order]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
    top = rank < size
    group, key, rank = group[top], key[top], rank[top]
    langs = sorted(profiles)
    names = sorted({g for own in profiles.values() for g in own})
    places = np.full((len(names) + 1, len(langs)), -1, np.int64)
    for j, lang in enumerate(langs):
        for r, gram in enumerate(profiles[lang]):
            places[int(np.searchsorted(names, gram)), j] = r
    keys = np.array([grams.key_of(g) for g in names])
    by = np.argsort(keys)
    at = np.minimum(np.searchsorted(keys[by], key), len(names) - 1)
    at = np.where(keys[by][at] == key, by[at], len(names))
    found = places[at]
    apart = np.where(found < 0, size, np.abs(found - rank[:, None]))
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    distance = np.add.reduceat(apart, starts, axis=0)
    n = np.diff(np.append(starts, len(group)))
    best = distance.argmin(axis=1)
    low = distance.min(axis=1)
    score = 1 - low / (n * size)
    for i, b, s in zip(group[starts].tolist(), best.tolist(), score.tolist(), strict=True):
        out[i] = (langs[b], min(1.0, max(0.0, s)))
    return out


def identify(docs: DataFrame, profiles: dict[str, list[str]], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs and lang_pred, score (0 to 1: 1 - mean out-of-place distance / profile length).

    Null texts, empty texts and texts without a letter have `und` and 0. Columns of these names are replaced;
    names gives the two others.
    """
    kept = [c for c in docs.columns if c not in names]

    def run(batches):
        for batch in batches:
            texts = batch.column(kept.index(text_col)).to_pylist()
            found: list[tuple[str, float]] = []
            for a, b in chunks([len(x or "") for x in texts], AT_ONCE):
                found += predict(texts[a:b], profiles)
            new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*kept, *names])

    bounded_batches(docs.sparkSession)
    had = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, f"{had}, `{names[0]}` string, `{names[1]}` double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learnt where crc32(doc_id) mod 4 isn't 2."""
    docs = documents(spark, sf_dir)
    profiles = train_profiles(docs, fold("doc_id", 4) != 2)
    rows = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text")
    return identify(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")
