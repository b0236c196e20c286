"""Verification of near duplicates on five-word shingles: all pairs whose shingle sets have a Jaccard similarity of 0.8 or more.

SimHash at 3 bits finds but few of these (at 0.8, fingerprints of 64 bits differ in ten on the average, and a radius
that takes in nearly all pairs, about 19 bits, leaves no selective key), so it isn't the only source of candidates.

Each text has 128 minhashes, and each run of four of them is a key. A pair at similarity 0.8 shares at least
one of the 32 keys but for one in 20 million (1 - 0.8 ^ 4, to the 32nd), a more similar one sooner. Keys only
propose pairs; a pair counts if its whole shingle sets agree.

Texts of equal shingle sets are one to begin with. Candidates come in two rounds. First each text is held against the
smallest id of each of its keys. Pairs that this has put into one group need no further look; of the others that share a
key, those are candidates whose minhashes don't rule out 0.8 (at it, fewer than LEAST_EQUAL of 128 agree once in 10
million pairs). They are never written out as pairs, of which there are as many as the square of a family of texts that
are alike: each key gives its candidates' families, and the texts of a family meet in blocks, where whole shingle
sets are held against each other by a product of matrices and a spanning star of each group is returned.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import byte_values, materialize
from folio.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
BANDS, ROWS = 32, 4
LEAST_EQUAL = 77
#: Rows of a key that one task joins or compares at once; keys with more are dealt out.
BLOCK = 256
#: A block of a family holds 4 * BLOCK texts of so many bytes in all, about; families with more are dealt out as pairs of blocks.
FAMILY_BYTES = 8 << 20
#: Shingles that are multiplied at once.
COLUMNS = 2048
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of the different shingles of a text's words; fewer words are one shingle."""
    words = text.lower().split()
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) > SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of different hashes."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def _minhashes(own: np.ndarray) -> np.ndarray:
    out = np.full(len(_FACTORS), (1 << 64) - 1, np.uint64)
    for i in range(0, len(own), 2048):  # bounded memory for very long texts
        np.minimum(out, (own[i : i + 2048, None] * _FACTORS).min(axis=0), out=out)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id long, digest, sketch, keys): a hash of the shingle set, a byte of each minhash, and a key of each band."""

    def run(batches):
        for batch in batches:
            digests, sketches, keys = [], [], []
            for text in byte_values(batch.column(1)):
                own = shingles(text)
                found = _minhashes(own)
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                sketches.append((found >> np.uint64(32)).astype(np.uint8).tobytes())
                keys.append([xxhash.xxh64_intdigest(x.tobytes(), n) - (1 << 63) for n, x in enumerate(found.reshape(BANDS, ROWS))])
            columns = [pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "digest", "sketch", "keys"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_col)
    return rows.mapInArrow(run, "id long, digest binary, sketch binary, keys array<long>")


def _dealt_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join; the left rows of a key with many are dealt out, each part with a copy of the right row."""
    many = left.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1")
    many = F.broadcast(many)
    dealt = F.pmod(F.xxhash64(*left.columns), F.coalesce("parts", F.lit(1))).cast("int")
    left = left.join(many, key, "left").withColumn("part", dealt).drop("parts")
    right = right.join(many, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, [key, "part"]).drop("part")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose texts (id, text) are near copies."""

    def run(batches):
        for batch in batches:
            known, at = {}, [-1]
            a, b = byte_values(batch.column(2)), byte_values(batch.column(3))
            for i, v in enumerate(batch.column(1).to_pylist()):
                if v not in known:  # the right text is often the same
                    known = {v: shingles(b[i])}
                if similarity(shingles(a[i]), known[v]) >= SIMILARITY:
                    at.append(i)
            yield batch.select([0, 1]).take(pa.array(at[1:], pa.int64()))

    left = _dealt_join(pairs, texts.select(F.col("id").alias("u"), F.col("text").alias("a")), "u")
    both = _dealt_join(left.select("u", "v", "a"), texts.select(F.col("id").alias("v"), F.col("text").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _labels(near: np.ndarray) -> np.ndarray:
    """The first member of each row's component; near: a symmetric matrix."""
    label = np.full(len(near), -1)
    for i in range(len(near)):
        if label[i] < 0:
            label[i], todo = i, [i]
            while todo:
                new = np.flatnonzero(near[todo.pop()] & (label < 0))
                label[new] = i
                todo += new.tolist()
    return label


def _apart(batches):
    """Batches sorted by (key, lo, hi): of each run, the ids that have a candidate in another group, and a group that all groups of the family name."""
    for ids, root, sketch in _runs(batches):
        if (root == root[0]).all():
            continue
        near = np.stack([(sketch == own).sum(axis=1) >= LEAST_EQUAL for own in sketch])
        same = root[:, None] == root
        some = (near & ~same).any(axis=1)
        if some.any():
            low = root[_labels(near | same)]
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (ids, root, low)], names=["id", "root", "low"])


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets have in common."""
    sizes = list(map(len, sets))
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    row, column = np.repeat(np.arange(len(sets)), sizes)[keep], (np.cumsum(times > 1) - 1)[column[keep]]
    order = np.argsort(column)
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for i in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [i, i + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - i] = 1
        out += part @ part.T
    return out


def _linked(batches):
    """Batches (family, lo, hi, id, root, text) sorted by the first three: stars of near copies in different groups."""
    run, rows = None, []

    def stars():
        rows.sort()
        ids, root = np.array([x[0] for x in rows]), np.array([x[1] for x in rows])
        sizes, both = np.array([len(x[2]) for x in rows]), _shared([x[2] for x in rows])
        near = both / (sizes[:, None] + sizes - both.astype(float)) >= SIMILARITY
        label = _labels(near | (root[:, None] == root))
        out = root != root[label]
        return pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(ids[label[out]])], names=["u", "v"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for *own, i, root, text in zip(*columns, byte_values(batch.column(5)), strict=True):
            if own != run:
                if len(rows) > 1:
                    yield stars()
                run, rows = own, []
            rows.append((i, root, shingles(text)))
    if len(rows) > 1:
        yield stars()


def _runs(batches):
    key, rows = None, []

    def block():
        rows.sort()
        ids, root, sketch = zip(*rows, strict=True)
        return np.array(ids), np.array(root), np.frombuffer(b"".join(sketch), np.uint8).reshape(len(ids), -1)

    for batch in batches:
        for k, lo, hi, i, root, sketch in zip(*(batch.column(n).to_pylist() for n in ("key", "lo", "hi", "id", "root", "sketch")), strict=True):
            if (k, lo, hi) != key:
                if len(rows) > 1:
                    yield block()
                key, rows = (k, lo, hi), []
            rows.append((i, root, sketch))
    if len(rows) > 1:
        yield block()


def _met(rows: DataFrame, by: str) -> DataFrame:
    """rows, sorted by (by, lo, hi) in the task of these: each pair of a key's blocks once. Column blocks becomes lo and hi."""
    other = [c for c in rows.columns if c not in (by, "blocks")]
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.select(by, *other, "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select(by, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), *other)
    return rows.repartition(by, "lo", "hi").sortWithinPartitions(by, "lo", "hi")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", proposed: Sequence[DataFrame] = ()) -> DataFrame:
    """(node, root) of every id that isn't the smallest one of its group; groups are joined by near copies.

    proposed: tables (id_col, component_id) of groups whose members are held against the group's smallest id too.
    Rows with null ids are left out. Texts without words are copies of each other.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = materialize(signatures(docs, id_col, text_col), "signatures")
    least = signed.groupBy("digest").agg(F.min("id").alias("v"), F.max("id").alias("last")).where("v < last").select("digest", "v")
    twins = materialize(signed.select("id", "digest").join(least, "digest").where("id != v").select(F.col("id").alias("u"), "v"), "twins")
    signed = signed.join(twins.select(F.col("u").alias("id")), "id", "left_anti")
    keyed = signed.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("v"), F.max("id").alias("last")).where("v < last").select("key", "v")
    keyed = materialize(_dealt_join(keyed, shared, "key"), "keyed")
    first = keyed.where("id != v").select(F.col("id").alias("u"), "v")
    for found in proposed:
        found = found.select(F.col(id_col).cast("long").alias("x"), F.col("component_id").cast("long").alias("y")).where("x != y")
        for end in ("x", "y"):  # of texts that are one, the smallest id stands for all
            found = found.join(twins.toDF(end, "one"), end, "left").withColumn(end, F.coalesce("one", end)).drop("one")
        first = first.union(found.where("x != y").select("x", "y"))
    first = materialize(first.distinct(), "pairs")
    edges = materialize(verified(first, texts), "verified")
    roots = materialize(components(edges), "roots")
    left = keyed.select("key", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    left = materialize(left, "rooted")
    mixed = left.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("a < b")
    rows = _dealt_join(left, mixed.select("key", "blocks"), "key").join(signed.select("id", "sketch"), "id")
    near = materialize(_met(rows, "key").mapInArrow(_apart, "id long, root long, low long").distinct(), "near")
    families = components(near.select(F.col("root").alias("u"), F.col("low").alias("v"))).select(F.col("node").alias("root"), F.col("root").alias("family"))
    members = near.select("id", "root").distinct().join(families, "root", "left").withColumn("family", F.coalesce("family", "root"))
    members = materialize(members.join(texts, "id").select("family", "id", "root", "text"), "members")
    count = F.greatest(F.count("*") / (4 * BLOCK), F.sum(F.octet_length("text")) / FAMILY_BYTES)
    blocks = members.groupBy("family").agg(F.ceil(count).cast("int").alias("blocks"))
    more = materialize(_met(_dealt_join(members, blocks, "family"), "family").mapInArrow(_linked, "u long, v long"), "more")
    return components(roots.toDF("u", "v").union(more).union(twins))
