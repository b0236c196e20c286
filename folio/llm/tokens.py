"""Token ids in binary blocks with Elias-Fano document boundaries.

A folder holds blocks of documents in ascending id order, a row of Parquet each, uncompressed: (part, block, docs, ids, data). So
Spark writes them to any store, and counts are read without the data. The data of a block:

    magic "EFT1" | header (see HEAD) | document ids, int64 | null-id flags, 1 bit each
    | Elias-Fano low bits | Elias-Fano high bits | select samples, uint32 | token ids, uint16 or uint32

The boundaries (ends of documents within the block's id array) take about 2 + log2(ids per
document) bits each; select() finds any of them from a sampled directory without a table of
64-bit offsets, and the reader finds every document by it.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.common import bounded_batches, byte_values, documents, scratch_path

MAGIC = b"EFT1"
HEAD = np.dtype([("part", "<u4"), ("block", "<u4"), ("width", "<u4"), ("low", "<u4"), ("docs", "<u8"), ("ids", "<u8")])
#: A block ends with the document that reaches so many ids.
BLOCK_IDS = 8_000_000
#: Distinct words, and pieces, of a generation whose ids a task keeps (it keeps two).
WORDS_KEPT = 150_000
#: One of so many high bits' ones has its place stored.
EVERY = 64


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space, with select."""

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.lows, self.highs, self.samples = n, low, lows, highs, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        bits = (v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        place = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros((top >> low) + n + 1, np.uint8)
        high[place] = 1
        return cls(n, low, lows, np.packbits(high, bitorder="little"), place[::EVERY].astype(np.uint32))

    def _low(self, i: int) -> int:
        a = i * self.low
        word = int.from_bytes(self.lows[a >> 3 : (a + self.low + 7) >> 3].tobytes(), "little")
        return word >> (a & 7) & (1 << self.low) - 1

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // EVERY]), i % EVERY
        byte = at >> 3
        word = int(self.highs[byte]) >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = int(self.highs[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - i) << self.low | self._low(i)

    def all(self) -> np.ndarray:
        place = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        lows = bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low, dtype=np.int64))
        return (place - np.arange(self.n) << self.low) + lows


def pack(part: int, block: int, ids: list, tokens: list[bytes], width: int) -> bytes:
    """A block from document ids and their token ids (little-endian, `width` bytes each)."""
    ef = EliasFano.encode(np.cumsum([len(x) // width for x in tokens]))
    known = np.array([x if x is not None else 0 for x in ids], "<i8")
    null = np.packbits(np.array([x is None for x in ids], bool), bitorder="little")
    total = sum(map(len, tokens)) // width
    head = np.array([(part, block, width, ef.low, len(ids), total)], HEAD)
    sizes = np.array([len(ef.lows), len(ef.highs), len(ef.samples)], "<u8")
    return b"".join([MAGIC, head.tobytes(), sizes.tobytes(), known.tobytes(), null.tobytes(), ef.lows.tobytes(), ef.highs.tobytes(), ef.samples.astype("<u4").tobytes(), *tokens])


class Block:
    """A block that has been read: ids of documents, boundaries, token ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token block")
        head = np.frombuffer(data, HEAD, 1, 4)[0]
        self.part, self.block, width, low, n, total = (int(head[x]) for x in ("part", "block", "width", "low", "docs", "ids"))
        p = 4 + HEAD.itemsize
        lows, highs, samples = (int(x) for x in np.frombuffer(data, "<u8", 3, p))
        p += 24
        self.known, p = np.frombuffer(data, "<i8", n, p), p + 8 * n
        self.null, p = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, p), bitorder="little")[:n].astype(bool), p + (n + 7) // 8
        parts = []
        for kind, count in ((np.uint8, lows), (np.uint8, highs), ("<u4", samples)):
            parts.append(np.frombuffer(data, kind, count, p))
            p += parts[-1].nbytes
        self.ends = EliasFano(n, low, *parts)
        self.tokens = np.frombuffer(data, f"<u{width}", total, p)

    def document(self, i: int) -> np.ndarray:
        """Token ids of the i-th document, by two selects."""
        return self.tokens[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


#: The normalizer and the pattern of the pre-tokenizer (fixed values) under which words can be encoded one by one.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
# Letters (ASCII and Latin-1) and then ASCII punctuation other than the apostrophe: such a word is two
# pre-tokens at most, and lower case of its letters is the same character by character.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-;=-@\[-`{-~]*)")


class WordIds(dict):
    """Word (bytes) -> its ids as bytes, for a tokenizer under which words stand alone; under others, whole texts are encoded by the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte_level = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.pieces: dict[str, bytes] = {"": b""}
        self.older: dict[bytes, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}
        self.letter = "H" if self.width == 2 else "I"
        own = json.loads(self.tokenizer.to_str())
        split = (own["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_word = (own["normalizer"] or {}).get("normalizers") == _NORMALIZERS and split[0] == _SPLIT and [x["type"] for x in split[1:]] == ["ByteLevel"]

    def piece(self, text: str) -> bytes:
        out = self.pieces.get(text)
        if out is None:
            out = self.older_pieces.get(text)
            if out is None:  # ASCII letters and punctuation are shown as themselves
                shown = text if text.isascii() else "".join(map(self.byte_level.__getitem__, text.encode()))
                out = self.number([x.id for x in self.model.tokenize(shown)])
            self.pieces[text] = out
        return out

    def number(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def __missing__(self, word: bytes) -> bytes:
        out = self.older.get(word)
        if out is None:
            if word.isalpha():  # ASCII letters only
                out = self.piece(word.decode().lower())
            elif plain := _PLAIN.fullmatch(text := word.decode()):
                out = self.piece(plain[1].lower()) + self.piece(plain[2])
            else:
                out = self.number(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self[word] = out
        return out

    def encode(self, text: bytes) -> bytes:
        if not self.by_word:
            return self.number(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)
        if len(self) > WORDS_KEPT:  # what comes again stays
            self.older = dict(self)
            self.clear()
        if len(self.pieces) > WORDS_KEPT:
            self.pieces, self.older_pieces = {"": b""}, self.pieces
        return b"".join(map(self.__getitem__, text.split()))


_encoders: dict[str, WordIds] = {}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Encode each whole text, append end_id, and write token files to `path` in ascending id order.

    tokenizer: a file of the tokenizers library. parts: tasks that write; as many as the input has partitions, or shuffles have if more.
    Null texts count as empty; null ids come first; repeated ids stay, next to each other. The id column
    must be of an integer type. Other columns go. An empty table writes no block.
    """
    bounded_batches(docs.sparkSession)
    parts = parts or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    def run(batches):
        coder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, WordIds(tokenizer))
        end = coder.number([end_id])
        part, block, ids, tokens, size = TaskContext.get().partitionId(), 0, [], [], 0

        def packed():
            columns = [pa.array([x]) for x in (part, block, len(ids), size // coder.width)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([pack(part, block, ids, tokens, coder.width)], pa.binary())], names=["part", "block", "docs", "ids", "data"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), strict=True):
                ids.append(i)
                tokens.append(coder.encode(text) + end)
                size += len(tokens[-1])
                if size >= BLOCK_IDS * coder.width:
                    yield packed()
                    block, ids, tokens, size = block + 1, [], [], 0
        if ids:
            yield packed()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(parts, "id").sortWithinPartitions("id")
    rows.mapInArrow(run, "part long, block long, docs long, ids long, data binary").write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, place, doc_id, local_start, n_tokens, ids_crc32) of each document in the files at `path`, found by select."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                own = Block(data)
                n = own.ends.n
                ends = np.fromiter(map(own.ends.select, range(n)), np.int64, n)
                starts = np.concatenate([[0], ends[:-1]])
                wide = own.tokens.astype("<u4")
                crc = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                columns = [pa.array(np.full(n, own.part)), pa.array(np.full(n, own.block)), pa.array(np.arange(n)), pa.array(own.known, mask=own.null), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "place", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(path).select("data")
    return blocks.mapInArrow(run, "part long, block long, place long, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, base): the number of ids in all blocks before. Only a row of counts for each block meets in one task; data isn't read."""
    before = F.coalesce(F.sum("ids").over(W.orderBy("part", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return spark.read.parquet(path).select("part", "block", before.alias("base"))


def read_with_offsets(spark: SparkSession, path: str) -> DataFrame:
    """read_tokens() and start: the number of ids in all documents before."""
    return read_tokens(spark, path).join(block_starts(spark, path), ["part", "block"]).withColumn("start", F.col("base") + F.col("local_start"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from its token file."""
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_with_offsets(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
