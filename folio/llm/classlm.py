"""Brown-style class bigram language model: exchange clustering, class transitions, word emissions.

Class 0 is the end of a text, classes 1 to CLASSES are found by exchange.

The CORE most frequent words are clustered in rounds, and with them GROUPS of all other words by their last bytes. A round
counts, over the whole training corpus, the classes before and after each of these items, and moves a part of them to the
class that raises the likelihood most (the exact difference for each, its own counts taken out); it is kept only if
the likelihood did rise. Then every other word that is seen more than once has an exchange of its own: its contexts are
gathered by word, and it goes to the class that gains most. So at any size of the corpus a word shares another's class by its spelling only
if it is seen once or not at all; what comes to the driver is items x classes.

P(word | before) = P(class | class before) * P(word | class). Transitions are smoothed towards class frequencies. In a
class, each known word's count is less by a discount, and what this leaves is for unseen words: most of it divided evenly over as many
as are estimated (Chao's estimate from the words seen once and twice, dealt to classes like the words seen once) that look like the words seen once; the
rest is for other strings, by a spelling model (bytes in a row, less what it gives to known words). So the probabilities of
all words sum to 1, and letters at random get next to nothing.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import byte_values, documents, fold, materialize

CLASSES = 48
ALL = CLASSES + 1
#: Words that are clustered in rounds and whose counts every task holds; item 0 is the end of a text.
CORE = 32_000
#: Items behind those: groups of other words, by a hash of their last ENDING bytes.
GROUPS = 2_048
ENDING = 4
ROUNDS = 5
#: Times within a round at which the class bigrams follow the moves.
STEPS = 20
#: Weight of class frequencies in transitions.
SMOOTH = 20.0
#: Share of the words seen once, and of unseen words' probability, that is for strings that don't look like words.
ODD = 0.02
END = "\n"  # no word contains it
UNSEEN = 64  # more than any class
_BLOCK = 256  # items in a row of counts


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, how many each has): A-Z in lower case, cut at ASCII white space. Null texts are empty."""
    low = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lists = pc.ascii_split_whitespace(low)
    some = pc.not_equal(low, "")
    return lists.filter(some).flatten(), np.where(some.to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False), 0).astype(np.int64)


def _group(word: bytes) -> int:
    return zlib.crc32(word[-ENDING:]) % GROUPS


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all rows; END counts the rows. Null texts are empty."""

    def run(batches):
        parts, rows = [], 0
        for batch in batches:
            parts.append(_words(batch.column(0))[0])
            rows += batch.num_rows
            if sum(map(len, parts)) > 5_000_000:
                yield counted(parts)
                parts = []
        if parts:
            yield counted(parts)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([rows])], names=["word", "n"])

    def counted(parts):
        found = pa.chunked_array(parts).value_counts()
        return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "n"])

    found = texts.select(text_col).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """(word, n) of the `most` most frequent words; by falling count and word.

    A histogram over classes of counts (about nine to each doubling) gives the count to cut at; within the class that
    is cut, the order decides. So the driver gets these words and no more, however many tasks hold them.
    """
    level = F.floor(F.log2("n") * 9)
    total, cut = 0, -1
    for at, n in sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True):
        if total + n > most:
            cut = at
            break
        total += n
    rows = counts.where(level > cut).select("word", "n").collect()
    rows += counts.where(level == cut).orderBy(F.desc("n"), "word").select("word", "n").limit(most - total).collect() if most > total else []
    return sorted(((r[0], r[1]) for r in rows), key=lambda x: (-x[1], x[0]))


class Spelling:
    """Probabilities of unseen words by their bytes in a row; the end of a word is the byte 10, which no word contains."""

    def __init__(self, seen: np.ndarray):
        n = seen.reshape(256, 256) + 0.1
        n[10, 10] = 0.0  # no empty words
        with np.errstate(divide="ignore"):
            self.table = np.log10(n / n.sum(axis=1, keepdims=True))
        self.known = 0.0  # what it gives to words that are known
        self.least = 0.0  # log10 of a byte, on the average, of strings that look like words
        self.unseen = 1.0  # estimated number of unseen words

    @staticmethod
    def pairs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(code of each pair of bytes in a row, place of each word's first pair)."""
        x = np.frombuffer(b"\n" + b"\n".join(words) + b"\n", np.uint8).astype(np.int64)
        return x[:-1] * 256 + x[1:], np.flatnonzero(x[:-1] == 10)

    def log(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(log10 of the probability of each word, the same for a byte)."""
        if not words:
            return np.zeros(0), np.zeros(0)
        codes, starts = self.pairs(words)
        total = np.add.reduceat(self.table.ravel()[codes], starts)
        return total, total / np.diff(np.append(starts, len(codes)))

    def share(self, words: list[bytes]) -> np.ndarray:
        """log10 of each word's share of what unseen words have."""
        total, each = self.log(words)
        return np.where(each >= self.least, math.log10((1 - ODD) / self.unseen), total + math.log10(ODD / (1 - self.known)))


def learn_spelling(counts: DataFrame) -> Spelling:
    """From (word, n): the words seen once, and how much goes to known words."""

    def pairs(batches):
        total = np.zeros(65536, np.int64)
        for batch in batches:
            if words := byte_values(batch.column(0)):
                total += np.bincount(Spelling.pairs(words)[0], minlength=65536)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    words = counts.where(F.col("word") != END)
    seen = np.zeros(65536)
    for pair, n in words.where("n = 1").select("word").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        seen[pair] = n
    own = Spelling(seen)

    def given(batches):
        for batch in batches:
            total, each = own.log(byte_values(batch.column(0)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(10.0**total), pa.array(each)], names=["n", "p", "each"])

    once = F.when(F.col("n") == 1, F.col("each"))
    known, least, n1, n2 = words.select("word", "n").mapInArrow(given, "n long, p double, each double").agg(F.sum("p"), F.percentile_approx(once, ODD, 10_000), F.count(once), F.count(F.when(F.col("n") == 2, 1))).first()
    own.known, own.least = min(1 - 1e-9, known or 0.0), least or 0.0
    own.unseen = max(1.0, n1 * (n1 - 1) / (2 * (n2 + 1)))
    return own


def groups_once(counts: DataFrame) -> np.ndarray:
    """How many of the words of each group are seen once, from (word, n)."""

    def run(batches):
        for batch in batches:
            found = np.bincount([_group(w) for w in byte_values(batch.column(0))], minlength=GROUPS) if batch.num_rows else np.zeros(GROUPS, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(GROUPS)), pa.array(found.astype(np.int64))], names=["g", "n"])

    out = np.zeros(GROUPS)
    for g, n in counts.where((F.col("n") == 1) & (F.col("word") != END)).select("word").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n")).collect():
        out[g] = n
    return out


def sequences(docs: DataFrame, train: Column, core: dict[bytes, int], spelling: Spelling, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of texts: (block, ids, train, sizes, items, others, words, shares), one for each Arrow batch of docs.

    sizes: tokens of each text; items: little-endian uint16 of all texts' words, an end after each text; others: little-endian uint32, for each
    item beyond the core the number of its word in words; shares: Spelling.share of those words.
    """
    other = len(core) + 1

    def run(batches):
        block = TaskContext.get().partitionId() << 36
        for batch in batches:
            flat, sizes = _words(batch.column(2))
            named = flat.dictionary_encode()
            own = byte_values(named.dictionary)
            item = np.array([core.get(w) or other + _group(w) for w in own], np.int64)
            number = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            items = np.zeros(len(flat) + len(sizes), "<u2")
            ends = np.cumsum(sizes + 1) - 1
            inside = np.ones(len(items), bool)
            inside[ends] = False
            items[inside] = item[number] if len(number) else 0
            beyond = np.flatnonzero(item >= other)
            place = np.zeros(len(own), np.int64)
            place[beyond] = np.arange(len(beyond))
            others = place[number[item[number] >= other]] if len(number) else number
            words = named.dictionary.take(pa.array(beyond))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            columns = [pa.array([block]), one(batch.column(0)), one(batch.column(1)), one(pa.array(sizes + 1, pa.int32())), pa.array([items.tobytes()]), pa.array([others.astype("<u4").tobytes()])]
            yield pa.RecordBatch.from_arrays([*columns, one(words), one(pa.array(spelling.share(byte_values(words)), pa.float32()))], names=["block", "ids", "train", "sizes", "items", "others", "words", "shares"])
            block += 1

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"block long, ids array<{kind}>, train array<boolean>, sizes array<int>, items binary, others binary, words array<string>, shares array<float>")


def _contexts(x: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class before, class after) of the items x, texts in a row."""
    own = classes[x]
    after = np.concatenate([own[1:], [0]])
    after[x == 0] = 0  # nothing is told by the text after
    return np.concatenate([[0], own[:-1]]), after


def _blocks(batch: pa.RecordBatch, train: int, sizes: int, items: int):
    """(number, items, whether each is of a training text) of the blocks in a batch; train, sizes, items: its columns."""
    for i in range(batch.num_rows):
        x = np.frombuffer(batch.column(items)[i].as_py(), "<u2").astype(np.int64)
        use = batch.column(train)[i].values.to_numpy(zero_copy_only=False).astype(bool)
        yield i, x, np.repeat(use, batch.column(sizes)[i].values.to_numpy(zero_copy_only=False))


def context_counts(rows: DataFrame, classes: np.ndarray) -> np.ndarray:
    """(items, 2 * ALL): how often each class stands before, and after, each item of training texts, in sequences() rows."""
    n, wide = len(classes), 2 * ALL

    def count(batches):
        total = np.zeros(n * wide, np.int64)
        for batch in batches:
            for _, x, use in _blocks(batch, 0, 1, 2):
                x = x[use]
                before, after = _contexts(x, classes)
                total += np.bincount(x * wide + before, minlength=len(total))
                total += np.bincount(x * wide + ALL + after, minlength=len(total))
        rows = total.reshape(n, wide)
        for i in range(0, n, _BLOCK):
            part = rows[i : i + _BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // _BLOCK]), pa.array([zlib.compress(part.tobytes(), 1)])], names=["block", "counts"])

    def add(batches):
        own, total = None, None
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(data), np.int64)
                if block != own and own is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([zlib.compress(total.tobytes(), 1)])], names=["block", "counts"])
                own, total = block, part if block != own else total + part
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([zlib.compress(total.tobytes(), 1)])], names=["block", "counts"])

    parts = rows.select("train", "sizes", "items").mapInArrow(count, "block long, counts binary").repartition("block").sortWithinPartitions("block")
    out = np.zeros((n, wide), np.int64)
    for block, data in parts.mapInArrow(add, "block long, counts binary").collect():  # items x classes, whatever the corpus
        rows = np.frombuffer(zlib.decompress(data), np.int64).reshape(-1, wide)
        out[block * _BLOCK : block * _BLOCK + len(rows)] = rows
    return out


def bigrams(counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """(class before, class): counts, from the class before each item."""
    return np.stack([counts[classes == c, :ALL].sum(axis=0) for c in range(ALL)], axis=1).astype(float)


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(n: np.ndarray) -> float:
    """What class bigrams n add to the log likelihood of the corpus; the rest doesn't hang on the classes."""
    return float(_phi(n).sum() - _phi(n.sum(axis=0)).sum() - _phi(n.sum(axis=1)).sum())


def gains(counts: np.ndarray, own: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(words, CLASSES): the likelihood that each word brings to classes 1 to CLASSES, without its own counts in its class own."""
    left, right = counts[:, :ALL].astype(float), counts[:, ALL:].astype(float)
    l, r = left.sum(axis=1), right.sum(axis=1)  # noqa: E741
    ins, outs = n.sum(axis=0), n.sum(axis=1)
    out = np.empty((len(counts), CLASSES))
    for b in range(1, CLASSES + 1):
        mine = own == b
        taken = mine.astype(float)[:, None]
        before, after = np.maximum(n[:, b] - taken * left, 0), np.maximum(n[b] - taken * right, 0)
        i, o = np.maximum(ins[b] - taken[:, 0] * l, 0), np.maximum(outs[b] - taken[:, 0] * r, 0)
        gain = (_phi(before + left) - _phi(before)).sum(axis=1) + (_phi(after + right) - _phi(after)).sum(axis=1)
        out[:, b - 1] = gain - (_phi(i + l) - _phi(i)) - (_phi(o + r) - _phi(o))
    return out


def small_gains(counts: np.ndarray, own: np.ndarray, n: np.ndarray) -> np.ndarray:
    """gains() less the same for all classes, to the first order: for words whose counts are a small part of every class's."""
    left, right = counts[:, :ALL].astype(float), counts[:, ALL:].astype(float)
    l, r = left.sum(axis=1), right.sum(axis=1)  # noqa: E741
    ins, outs = n.sum(axis=0), n.sum(axis=1)
    log = np.log(n + 1)
    out = left @ log + right @ log.T - np.outer(l, np.log(ins + 1)) - np.outer(r, np.log(outs + 1))
    # its own class without the word
    rows = np.arange(len(counts))
    less = lambda a, b: np.log(np.maximum(a - b, 0) + 1)
    alone = (left * less(n[:, own].T, left)).sum(axis=1) + (right * less(n[own], right)).sum(axis=1) - l * less(ins[own], l) - r * less(outs[own], r)
    out[rows, own] = alone
    return out[:, 1:]


def first_classes(core: dict[bytes, int]) -> np.ndarray:
    """Where the exchange begins: by the last two bytes of a word, or the number of its group."""
    out = 1 + np.arange(len(core) + 1 + GROUPS) % CLASSES
    for word, item in core.items():
        out[item] = 1 + zlib.crc32(word[-2:]) % CLASSES
    out[0] = 0
    return out


def moved(counts: np.ndarray, classes: np.ndarray, n: np.ndarray, which: np.ndarray) -> np.ndarray:
    """classes after the items `which` have gone, some at a time, to their best class; n follows them, so they don't all run to one class."""
    classes, n = classes.copy(), n.copy()
    step = max(1, len(which) // STEPS)
    for i in range(0, len(which), step):
        own = which[i : i + step]
        best = 1 + gains(counts[own], classes[own], n).argmax(axis=1)
        for item, c in zip(own[best != classes[own]], best[best != classes[own]], strict=True):
            left, right, a = counts[item, :ALL], counts[item, ALL:], classes[item]
            n[:, a] -= left
            n[a] -= right
            n[:, c] += left
            n[c] += right
            classes[item] = c
        np.maximum(n, 0, out=n)
    return classes


def cluster(rows: DataFrame, core: dict[bytes, int], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(class of each item, class bigrams, likelihoods of the rounds that were kept)."""
    classes, best, risen = first_classes(core), None, []
    part = 2  # one in so many items moves
    turn = np.arange(len(classes)) * 2654435761 % 2**32 >> 8
    for i in range(rounds + 1):
        counts = context_counts(rows, classes)
        n = bigrams(counts, classes)
        if best is None or likelihood(n) > risen[-1]:
            best = classes, n, counts
            risen.append(likelihood(n))
        else:  # too many at once
            part *= 2
        if i == rounds or not n[1:].any():
            break
        now, before, counts = best
        seen = np.flatnonzero(counts.any(axis=1) & ((turn + i) % part == 0))
        classes = moved(counts, now, before, seen[seen > 0])
    return best[0], best[1], risen


def other_classes(rows: DataFrame, classes: np.ndarray, n: np.ndarray) -> DataFrame:
    """(key, class) of the words beyond the core that occur more than once: each by its own contexts. key: xxhash64 of the word."""
    square, other = ALL * ALL, len(classes) - GROUPS

    def contexts(batches):
        for batch in batches:
            for i, x, use in _blocks(batch, 0, 1, 2):
                before, after = _contexts(x, classes)
                beyond = x >= other
                word = np.frombuffer(batch.column(3)[i].as_py(), "<u4").astype(np.int64)[use[beyond]]
                at = np.flatnonzero(beyond & use)
                codes = (word * ALL + classes[x[at]]) * square + before[at] * ALL + after[at]
                codes, times = np.unique(codes, return_counts=True)  # what a block holds of a word is one row for each context
                keys = np.array([xxhash.xxh64_intdigest(w, 42) for w in byte_values(batch.column(4)[i].values)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[codes // (square * ALL)]), pa.array(codes % (square * ALL) << 32 | times)], names=["key", "seen"])

    def choose(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, seen = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            code, times = seen >> 32, seen & (1 << 32) - 1
            first = np.concatenate([[True], key[1:] != key[:-1]])
            starts = np.flatnonzero(first)
            at = (np.cumsum(first) - 1) * 2 * ALL
            size = len(starts) * 2 * ALL
            counts = np.bincount(at + code % square // ALL, times, size) + np.bincount(at + ALL + code % ALL, times, size)
            keys, own, counts = key[starts], code[starts] // square, counts.reshape(-1, 2 * ALL)
            if held is not None and keys[0] == held[0][0]:
                counts[0] += held[2][0]
            elif held is not None:
                yield chosen(*held)
            held = keys[-1:], own[-1:], counts[-1:].copy()  # it may go on in the next batch
            yield chosen(keys[:-1], own[:-1], counts[:-1])
        if held is not None:
            yield chosen(*held)

    def chosen(keys, own, counts):
        many = counts[:, :ALL].sum(axis=1) > 1
        keys, own, counts = keys[many], own[many], counts[many]
        best = 1 + small_gains(counts, own, n).argmax(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(best.astype(np.int32))], names=["key", "class"])

    found = rows.select("train", "sizes", "items", "others", "words").mapInArrow(contexts, "key long, seen long")
    return found.repartition("key").sortWithinPartitions("key").mapInArrow(choose, "key long, class int")


def lexicon_of(counts: DataFrame, named: DataFrame) -> DataFrame:
    """(word, n, class) of the words beyond the core; class is null for those that are seen once."""
    words = counts.where(F.col("word") != END).withColumn("key", F.xxhash64("word"))
    return words.join(named, "key", "left").where(F.col("class").isNotNull() | (F.col("n") == 1)).select("word", "n", "class")


class Model:
    """Probabilities (log10) that scoring needs; its size doesn't grow with the corpus.

    n: class bigrams; known, once: how many words of each class are known, and are seen once.
    """

    def __init__(self, n: np.ndarray, known: np.ndarray, once: np.ndarray, less: float):
        mass = n.sum(axis=0)
        share = (mass + 1.0) / (mass.sum() + ALL)
        self.transition = np.log10((n + SMOOTH * share) / (n.sum(axis=1, keepdims=True) + SMOOTH))
        self.word = -np.log10(np.maximum(mass, 1))  # and log10 of the word's count less the discount
        left = np.where(mass > 0, less * known / np.maximum(mass, 1), 1.0)
        part = (once + 1 / CLASSES) / (once[1:].sum() + 1)  # of the unseen words
        self.unseen = np.log10(np.maximum(left, 1e-12)) - np.log10(part)  # and Spelling.share
        self.word[0] = self.unseen[0] = 0.0  # the end is all that its class has


def discount(once: int, twice: int) -> float:
    return min(0.95, max(0.1, once / max(1, once + 2 * twice)))


def classed(rows: DataFrame, lexicon: DataFrame, classes: np.ndarray, frequent: np.ndarray, tokens: int, distinct: int, less: float) -> DataFrame:
    """(id, train, classes, n_tokens, n_known, base_score, words), one for each text of sequences() rows.

    classes: a byte for each word and the end, UNSEEN more for unseen words; words: sum of log10 of the known words' counts, less the discount,
    and of the unseen ones' Spelling.share. A block's words beyond the core meet their count and class by a join, and their block by its number.
    """
    kind = rows.schema["ids"].dataType.elementType
    other = len(frequent)
    base = lambda n: np.log10((n + 0.1) / (tokens + 0.1 * (distinct + 1)))
    core_base, core_log = base(frequent), np.log10(np.maximum(frequent - less, 1e-9))
    core_log[0] = 0.0  # the end is all that its class has
    names = ["id", "train", "classes", "n_tokens", "n_known", "base_score", "words"]

    def finish(ids, train, sizes, items, others, shares, number, n):
        x = np.frombuffer(items, "<u2").astype(np.int64)
        own, at = classes[x].astype(np.uint8), x >= other
        word = np.frombuffer(others, "<u4")
        times = n[word]
        own[at] = np.where(number[word] > 0, number[word], own[at] + np.where(times > 0, 0, UNSEEN))
        core = np.where(at, 0, x)
        base_part, log_part, known = core_base[core], core_log[core], frequent[core] > 0
        base_part[at], known[at] = base(times), times > 0
        log_part[at] = np.where(times > 0, np.log10(np.maximum(times - less, 1e-9)), shares[word])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        text = [own[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        sums = [np.add.reduceat(v, starts) for v in (known.astype(np.int64), base_part, log_part)]
        return pa.RecordBatch.from_arrays([ids, train, pa.array(text, pa.binary()), pa.array(sizes), *map(pa.array, sums)], names=names)

    def run(batches):
        for batch in batches:
            lists = [batch.column(i) for i in range(len(arrays) + 2)]
            for i in range(batch.num_rows):
                ids, train, sizes, items, others, shares, at, times = (x[i] for x in lists)
                shares = shares.values.to_numpy(zero_copy_only=False).astype(float)
                number, n = np.zeros(len(shares), np.int64), np.zeros(len(shares), np.int64)
                if at.is_valid:
                    code = at.values.to_numpy()
                    number[code // UNSEEN], n[code // UNSEEN] = code % UNSEEN, times.values.to_numpy()
                yield finish(ids.values, train.values, sizes.values.to_numpy().astype(np.int64), items.as_py(), others.as_py(), shares, number, n)

    arrays = ["ids", "train", "sizes", "items", "others", "shares"]
    words = rows.select("block", F.posexplode("words").alias("at", "word")).join(lexicon, "word")
    words = words.select("block", (F.col("at").cast("long") * UNSEEN + F.coalesce("class", F.lit(0))).alias("at"), "n")
    words = words.groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("times"))  # a block's words, no more than its text has
    merged = rows.select("block", *arrays).join(words, "block", "left").select(*arrays, "at", "times")
    return merged.mapInArrow(run, f"id {kind.simpleString()}, train boolean, classes binary, n_tokens long, n_known long, base_score double, words double")


def class_bigrams(rows: DataFrame) -> np.ndarray:
    """(class before, class): counts over the training rows of classed()."""

    def count(batches):
        total = np.zeros(ALL * ALL, np.int64)
        for batch in batches:
            data = byte_values(batch.column(0))
            for i in range(0, len(data), 2000):
                x = np.frombuffer(b"".join(data[i : i + 2000]), np.uint8).astype(np.int64) % UNSEEN
                total += np.bincount(np.concatenate([[0], x[:-1]]) * ALL + x, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    out = np.zeros(ALL * ALL)
    for pair, n in rows.where("train").select("classes").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        out[pair] = n
    return out.reshape(ALL, ALL)


def with_scores(rows: DataFrame, model: Model) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of classed() rows."""
    kept = ["id", "n_tokens", "n_known", "base_score"]

    def run(batches):
        for batch in batches:
            parts = []
            for data in byte_values(batch.column(4)):
                x = np.frombuffer(data, np.uint8).astype(np.int64)
                own = x % UNSEEN
                parts.append(float(model.transition[np.concatenate([[0], own[:-1]]), own].sum() + np.where(x < UNSEEN, model.word[own], model.unseen[own]).sum()))
            total = np.array(parts) + batch.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(total)], names=[*kept, "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select(*kept, "classes", "words").mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", size: int = CORE) -> tuple[DataFrame, int]:
    """((id, n_tokens, n_known, base_score, score) of each row, number of training tokens); learnt from the rows that meet `train`.

    score is the log10 probability of the whole text. Null and empty texts have one token, the end. Repeated rows and
    null ids stay as they are; a condition that is null is false; ties at the edge of the core go by word. Without training
    rows all words are unseen.
    """
    counts = materialize(word_counts(docs.where(train), text_col), "words")
    of = lambda n: F.count(F.when((F.col("n") == n) & (F.col("word") != END), 1))
    tokens, distinct, once, twice, texts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), of(1), of(2), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("n"))), F.lit(0))).first()
    top = most_frequent(counts.where((F.col("word") != END) & (F.col("n") > 1)), size)
    core = {word.encode(): i + 1 for i, (word, _) in enumerate(top)}
    frequent = np.array([texts, *(n for _, n in top)], np.int64)
    spelling, alone = learn_spelling(counts), groups_once(counts)
    rows = materialize(sequences(docs, train, core, spelling, id_col, text_col), "sequences")
    classes, n, _ = cluster(rows, core)
    lexicon = materialize(lexicon_of(counts, other_classes(rows, classes, n)), "lexicon")
    less = discount(once, twice)
    found = materialize(classed(rows, lexicon, classes, frequent, tokens, distinct, less), "classed")
    known = np.bincount(classes[1 : len(top) + 1], minlength=ALL)
    for c, m in lexicon.where("class is not null").groupBy("class").count().collect():
        known[c] += m
    single = np.bincount(classes[len(top) + 1 :], alone, ALL)
    model = Model(class_bigrams(found), known + single, single, less)
    return with_scores(found, model).withColumnRenamed("id", id_col), tokens


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learnt where crc32(doc_id) mod 10 isn't 0."""
    found, tokens = score(documents(spark, sf_dir), fold("doc_id", 10) != 0)
    return found.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
