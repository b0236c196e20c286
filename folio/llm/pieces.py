"""SentencePiece encoding and decoding over shared prefixes.

A text is marked (spaces become U+2581, one stands in front) and cut into marked words that no piece
crosses. The distinct words of a batch are sorted, which is a depth-first walk of their trie, and
the forward states of the letters that a word shares with the one before are kept: a state holds the
last piece of the best way to there. Two kinds of model are read:

- unigram: the best way is the one with the highest sum of scores (Viterbi);
- bpe: scores are merge ranks, so their sums say nothing. The way to a place is the merge result of the
  letters before it, which is unique: a piece may follow another only if merging the two together leaves them
  as they are. That is checked once for each pair of pieces and kept.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import bounded_batches, chunks, documents

MARK = "▁"
#: Distinct words of a generation (a task keeps two), and pairs of pieces, that a task keeps (about 180 and 100 bytes each).
WORDS_KEPT = 150_000
PAIRS_KEPT = 300_000
#: Characters whose distinct words are sorted together.
AT_ONCE = 1_000_000
#: Piece ids and, behind them, letters that aren't pieces are numbers below this; the last one is the start of a word.
_CODES = 1 << 21


class Pieces:
    """A SentencePiece model's pieces. kind: "bpe" or "unigram"."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = kind
        ids = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: model.get_score(i) for i in plain}
        self.byte = {int(self.text[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.id), default=1)
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece goes on after a mark: words don't stand alone")
        self.worst = min(self.score.values(), default=0.0) - 10.0
        cut = "" if any("\n" in p for p in self.id) else "\n"
        self.words = re.compile(f"{MARK}*[^{MARK}{cut}]+|{MARK}+" + ("|\n" if cut else ""))
        self.raw = [bytes([int(self.text[i][3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else self.text[i].encode() for i in ids]
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # lengths of pieces that end with these letters (four, or three), the longest first; shorter ones that may
        ends: dict[str, set[int]] = {}
        for p in self.id:
            for n in (3, 4):
                if len(p) >= n:
                    ends.setdefault(p[-n:], {1, 2, 3}).add(len(p))
        self.reach = {x: tuple(sorted((n for n in found if n == 1 or n > len(x) or x[-n:] in self.id), reverse=True)) for x, found in ends.items() if len(x) == 4}
        self.short = {x: tuple(n for n in (3, 2, 1) if n == 1 or x[-n:] in self.id) for x in ends if len(x) == 3}

    def _merged(self, text: str) -> list[str]:
        """Merges of letters, the best-scored pair first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best = at = None
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _name(self, code: int) -> str:
        return "" if code == _CODES - 1 else self.text[code] if code < len(self.text) else chr(code - len(self.text))

    def _follows(self, key: int) -> bool:
        """Whether the second piece of a pair may follow the first: merging their letters gives the two again."""
        before, piece = self._name(key // _CODES), self._name(key % _CODES)
        if len(self.pairs) > PAIRS_KEPT:
            self.pairs.clear()
        found = self.pairs[key] = self._merged(before + piece) == ([before, piece] if before else [piece])
        return found

    def _best(self, word: str, end: int, total: list[float]) -> tuple[str, float]:
        """Unigram: the last piece of the best way to `end`, given the scores of the ways to all places before, and its score."""
        score = self.score
        best = (word[end - 1], total[end - 1] + score.get(word[end - 1], self.worst))
        for start in range(max(0, end - self.longest), end - 1):
            piece = word[start:end]
            if piece in score and total[start] + score[piece] > best[1]:
                best = (piece, total[start] + score[piece])
        return best

    def learn(self, words: set[str]) -> None:
        """Ids of all these words: one walk over their trie."""
        before, last, sizes_of, total = "", [_CODES - 1], [0], [0.0]
        reach, short, ids_of, pairs, letters = self.reach.get, self.short.get, self.id.get, self.pairs.get, len(self.text)
        bpe = self.kind == "bpe"
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], sizes_of[shared + 1 :], total[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                if bpe:  # the last piece of the merge result of the letters up to here
                    sizes = reach(word[end - 4 : end]) if end > 3 else None
                    if sizes is None:  # no piece of four or more letters ends so
                        sizes = short(word[end - 3 : end], (2, 1)) if end > 2 else (2, 1) if end == 2 else (1,)
                    for size in sizes:
                        if size > end:
                            continue
                        code = ids_of(word[end - size : end])
                        if code is None:
                            if size > 1:
                                continue
                            code = letters + ord(word[end - 1])
                        key = last[end - size] * _CODES + code
                        found = pairs(key)
                        if found or found is None and self._follows(key):
                            break
                else:
                    piece, s = self._best(word, end, total)
                    code, size = self.id.get(piece, letters + ord(piece[0])), len(piece)
                    total.append(s)
                last.append(code)
                sizes_of.append(size)
            before, ids, end = word, [], len(word)
            while end:
                code = last[end]
                if code < len(self.text):
                    ids.append(code)
                else:
                    letter = chr(code - len(self.text)).encode("utf-8", "replace")
                    ids += [self.byte.get(b, self.unknown) for b in reversed(letter)] if self.byte else [self.unknown]
                end -= sizes_of[end]
            ids.reverse()
            self.known[word] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian uint32."""
        cut = [self.words.findall(MARK + x.replace(" ", MARK)) if x else [] for x in texts]
        words = {w for own in cut for w in own}
        if len(self.known) > WORDS_KEPT:  # what comes again stays
            self.known, self.older = {}, self.known
        unseen = {w for w in words if w not in self.known}
        again = {w: self.older[w] for w in unseen if w in self.older}
        self.known |= again
        self.learn(unseen.difference(again))
        return [b"".join(map(self.known.__getitem__, own)) for own in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text; bytes that aren't UTF-8 become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


_loaded: dict[tuple[str, str], Pieces] = {}


def _pieces(path: str, kind: str) -> Pieces:
    if (path, kind) not in _loaded:
        _loaded[path, kind] = Pieces(path, kind)
    return _loaded[path, kind]


def encode(docs: DataFrame, model: str, kind: str = "bpe", text_col: str = "text", back: bool = False, held: bool = False) -> DataFrame:
    """All columns of docs and ids (little-endian uint32), n_tokens; with back, decoded: the text that decoding the ids gives;
    with held, instead of the text, same (whether the decoded text is the text) and decoded_sha256 (hex).

    Null and empty texts have no ids; whole texts are taken. Columns of these names are replaced.
    """
    bounded_batches(docs.sparkSession)
    new = {"ids": pa.binary(), "n_tokens": pa.int64()} | ({"decoded": pa.string()} if back else {}) | ({"same": pa.bool_(), "decoded_sha256": pa.string()} if held else {})
    kept = [c for c in docs.columns if c not in new and not (held and c == text_col)]

    def run(batches):
        own = _pieces(model, kind)
        for batch in batches:
            column = batch.column(len(kept))
            for a, b in chunks(pc.fill_null(pc.utf8_length(column), 0).to_pylist(), AT_ONCE):
                texts = [x or "" for x in column.slice(a, b - a).to_pylist()]
                ids = own.encode(texts)
                made = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if back or held:
                    decoded = [own.decode(np.frombuffer(x, "<u4")) for x in ids]
                if back:
                    made.append(pa.array(decoded, pa.string()))
                if held:
                    made.append(pa.array([x == y for x, y in zip(decoded, texts, strict=True)], pa.bool_()))
                    made.append(pa.array([hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in decoded], pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(kept))), *made], names=[*kept, *new])

    had = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    made = ", ".join(f"{c} {t}" for c, t in zip(new, ["binary", "long", *["string"] * back, "boolean", "string"], strict=False))
    return docs.select(*[f"`{c}`" for c in kept], F.col(f"`{text_col}`").alias("".join(kept) + "_")).mapInArrow(run, had + made)


def decode(rows: DataFrame, model: str, kind: str = "bpe", ids_col: str = "ids") -> DataFrame:
    """All columns of rows and decoded, the text of the ids. Null ids give a null text."""
    kept = [c for c in rows.columns if c != "decoded"]

    def run(batches):
        own = _pieces(model, kind)
        for batch in batches:
            ids = batch.column(kept.index(ids_col)).to_pylist()
            texts = [None if x is None else own.decode(np.frombuffer(x, "<u4")) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, "decoded"])

    had = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in kept)
    return rows.select(*[f"`{c}`" for c in kept]).mapInArrow(run, f"{had}decoded string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256, same (the decoded text is the text) of every document."""
    rows = encode(documents(spark, sf_dir).select("doc_id", "text"), model_path(), held=True)
    return rows.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "decoded_sha256", "same")
