"""SimHash near-duplicates, with candidates from pigeonring chains.

A fingerprint has four 16-bit segments in a ring. If two differ in at most 3 bits, then some
start segment exists whose chains of 1, 2, 3 and 4 segments differ in at most 0, 1, 2 and 3
bits (l * 3 / 4, rounded down: the strong form of the pigeonhole principle on a ring).
So the start segment is equal; of the two bytes of the next one at least one is equal; and of
the four bytes of the next two at least two are. Five pairs of bytes cover these cases, so
4 starts x 5 pairs give 20 keys of 32 exact bits for each distinct fingerprint. Fingerprints
that share a key are held against the chain budgets and then the full distance.

Equal fingerprints are grouped first, so a text repeated any number of times is one node.
Keys with many fingerprints are dealt out as pairs of blocks, and each pair of blocks returns
a spanning star of each of its components, never all its pairs.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import byte_values, chunks, documents, materialize
from folio.llm.graph import components

SEED = 42
DISTANCE = 3
#: Fingerprints of a key that one task compares at once; keys with more are dealt out as pairs of blocks.
BLOCK = 256
_BYTE_PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3))
_CHAINS = tuple((np.uint64((1 << 16 * n) - 1), n * DISTANCE // 4) for n in (1, 2, 3, 4))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the shingles of a text's words; a text without words has 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of each row. A null text counts as empty; null ids stay null; other columns go."""

    def run(batches):
        for batch in batches:
            texts = byte_values(batch.column(1))
            fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def chain_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): the 20 pigeonring keys of each fingerprint; key = number of the start and pair, start segment, two bytes."""

    def byte(n: int):
        return F.shiftrightunsigned("fp", 8 * (n % 8)).bitwiseAND(F.lit(255))

    keys = []
    for start in range(4):
        head = F.shiftrightunsigned("fp", 16 * start).bitwiseAND(F.lit(65535))
        for n, (a, b) in enumerate(_BYTE_PAIRS):
            first = 2 * start + 2
            keys.append(F.lit((start * 5 + n) << 32) + head * 65536 + byte(first + a) * 256 + byte(first + b))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _stars(keys: np.ndarray, fps: np.ndarray):
    """keys: one of each run; fps: runs x size. Pairs (fingerprint, smallest of its component in the run)."""
    size = fps.shape[1]
    step = max(1, 2_000_000 // (size * size))
    for i in range(0, len(keys), step):
        own = fps[i : i + step]
        turn = ((keys[i : i + step] >> 32) // 5 * 16).astype(np.uint64)[:, None]
        ring = (own >> turn) | (own << ((np.uint64(64) - turn) % np.uint64(64)))  # the start segment comes lowest
        apart = ring[:, :, None] ^ ring[:, None, :]
        near = np.ones(apart.shape, bool)
        for mask, budget in _CHAINS:
            near &= np.bitwise_count(apart & mask) <= budget
        label = np.broadcast_to(np.arange(size), own.shape)
        while True:
            new = np.where(near, label[:, None, :], size).min(axis=2)
            if (new == label).all():
                break
            label = new
        row, col = np.nonzero(label != np.arange(size))
        yield own[row, col].view(np.int64), own[row, label[row, col]].view(np.int64)


def _links(batches):
    """Batches sorted by (key, lo, hi): stars of each run of equal keys."""
    left = None
    for batch in _and_end(batches):
        cols = None if batch is None else [batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "lo", "hi", "fp")]
        if left is not None:
            cols = left if cols is None else [np.concatenate(x) for x in zip(left, cols, strict=True)]
        if cols is None or not len(cols[0]):
            continue
        key, lo, hi, fp = cols
        edge = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        starts = np.concatenate([[0], edge])
        if batch is not None:  # the last run may go on in the next batch
            left = [x[starts[-1] :] for x in cols]
            ends, starts = starts[1:], starts[:-1]
        else:
            ends = np.concatenate([edge, [len(key)]])
        sizes = ends - starts
        for size in np.unique(sizes[sizes > 1]):
            at = starts[sizes == size]
            runs = fp[at[:, None] + np.arange(size)].view(np.uint64)
            for u, v in _stars(key[at], runs):
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _and_end(batches):
    yield from batches
    yield None


def links(fps: DataFrame) -> DataFrame:
    """(u, v): for distinct fingerprints fp, edges with the same components as all pairs at 3 or fewer bits."""
    keyed = chain_keys(fps)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = keyed.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return rows.mapInArrow(_links, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row of docs.

    component_id is the smallest non-null id that is reachable over links, the own one included
    (null only if the whole component has null ids). Texts without words share fingerprint 0 and
    are linked. Repeated rows stay repeated; an empty table gives an empty table.
    """
    own = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(own.groupBy("fp").agg(F.min(id_col).alias("first")), "nodes")
    roots = components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    # nodes of an edge, roots included, get their component's smallest id; all others keep their own
    tied = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(tied.join(least, "root").select("fp", "component_id"), "components")
    return own.join(named, "fp", "left").select(id_col, "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
