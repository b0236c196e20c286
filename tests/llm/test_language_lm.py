import math
import random
import string
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folio.llm import classlm, language
from folio.llm.common import fold

SF = "/root/testdata/sf0.001"


def brute_profile(texts, size):
    counts = Counter()
    for text in texts:
        for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            for c in word:
                counts[c] += 1
        marked = language.MARK + language.MARK.join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + language.MARK
        for n in (2, 3):
            for i in range(len(marked) - n + 1):
                g = marked[i : i + n]
                if not (n == 3 and g[1] == language.MARK) and len(marked) > 2:
                    counts[g] += 1
    key = lambda g: (-counts[g], len(g) > 0 and [0 if c == language.MARK else ord(c) for c in g])
    return counts, sorted(counts, key=key)[:size]


def test_counts_match_brute_force(spark):
    texts = ["Der Hund. Der HUND", "le chat, un chat", "été 12 ab", "a", "--", ""]
    df = spark.createDataFrame([("x", t) for t in texts], "lang string, text string")
    got = {r.gram: r.n for r in language.gram_counts(df).collect()}
    assert got == dict(brute_profile(texts, 10)[0])


def test_distances_match_brute_force():
    profiles = {"a": brute_profile(["the cat and the dog and the hen"], 300)[1], "b": brute_profile(["der hund und die katze und das huhn"], 300)[1]}
    texts = ["the hen and a dog", "die katze und der hund", "", None, "123", "日本語 の テキスト", "e"]
    for text, (lang, score) in zip(texts, language.predict(texts, profiles), strict=True):
        own = brute_profile([text], 300)[1] if text else []
        if not any(c.isalpha() for c in text or ""):
            assert (lang, score) == ("und", 0.0)
            continue
        far = {k: sum(abs(p.index(g) - r) if g in p else 300 for r, g in sorted_by_key(text)) for k, p in profiles.items()}
        assert len(own) and lang == min(far, key=lambda k: (far[k], k))
        assert abs(score - (1 - far[lang] / (300 * len(list(sorted_by_key(text)))))) < 1e-12


def sorted_by_key(text):
    """A document's n-grams by rank: ties by length and then letters."""
    counts = brute_profile([text], 10**9)[0]
    code = lambda g: (len(g), [0 if c == language.MARK else ord(c) for c in g])
    return enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:300])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.op4_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    rates = {r.held_out: r.right for r in got.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()}
    assert rates[True] >= 0.97 and rates[False] >= 0.97


def test_language_edges(spark):
    rows = [(1, "hello there", "en", "c"), (2, None, "fr", "c"), (3, "salut toi", None, "c"), (None, "?", "en", "c"), (1, "hello there", "en", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    profiles = language.train_profiles(df, F.lit(True))
    assert list(profiles) == ["en"]
    got = [(r.doc_id, r.lang_pred) for r in language.identify(df, profiles).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "en"), (2, "und"), (3, "en"), (None, "und"), (1, "en")]))
    assert language.train_profiles(df.limit(0), F.lit(True)) == {}
    assert {r.lang_pred for r in language.identify(df, {}).collect()} == {"und"}


def test_class_model_scores(spark, tmp_path):
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rng = random.Random(3)
    junk = [(i, " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 10))) for _ in range(100))) for i in range(10**6, 10**6 + 200) if held(i)]
    docs.union(spark.createDataFrame(junk, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in classlm.op5_class_lm(spark, str(tmp_path)).collect()}
    texts = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in [*map(tuple, docs.collect()), *junk]}
    counts = Counter(w for i, own in texts.items() if not held(i) for w in own)
    n, v = sum(counts.values()), len(counts)
    better, per = 0.0, {}
    for i, words in texts.items():
        r = rows[i]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert abs(base - r.base_score) < 1e-6 * max(1, abs(base))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words), sum(counts[w] > 0 for w in words), n, held(i))
        assert r.score < 0
        better += (r.score - r.base_score) * (not held(i))
        per[i] = r.score / r.n_tokens
    assert better > 0 and len(junk) > 10
    assert max(per[i] for i, _ in junk) < min(p for i, p in per.items() if not held(i))


def brute_model(spark, rows, size):
    """The parts of score(), and the class of each word by plain Python from the core's classes on."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, word string")
    counts = classlm.word_counts(docs)
    top = classlm.most_frequent(counts.where(f"word != '{classlm.END}' and n > 1"), size)
    core = {w.encode(): i + 1 for i, (w, _) in enumerate(top)}
    spelling = classlm.learn_spelling(counts)
    seqs = classlm.materialize(classlm.sequences(docs, F.lit(True), core, spelling), "s")
    classes, n, risen = classlm.cluster(seqs, core)
    return counts, core, spelling, seqs, classes, n, risen


def sample(seed, texts=300):
    """Words of four kinds that follow each other by kind."""
    rng = random.Random(seed)
    kinds = [[f"{k}{i}" for i in range(30)] for k in "abcd"]
    return [(i, " ".join(rng.choices(kinds[j % 4], range(30, 0, -1))[0] for j in range(rng.randint(0, 40))), 1, "c") for i in range(texts)]


def test_words_beyond_the_core_have_an_exchange_of_their_own(spark):
    rows = sample(1)
    counts, core, _, seqs, classes, n, _ = brute_model(spark, rows, 20)
    got = {r.word: r["class"] for r in classlm.lexicon_of(counts, classlm.other_classes(seqs, classes, n)).where("class is not null").collect()}
    contexts = {}
    for _, text, _, _ in rows:
        words = text.encode().split()
        own = [0, *(int(classes[core.get(w) or classlm._group(w) - classlm.GROUPS]) for w in words), 0]
        for i, w in enumerate(words):
            if w not in core:
                x = contexts.setdefault(w.decode(), np.zeros((1, 2 * classlm.ALL)))
                x[0, own[i]] += 1
                x[0, classlm.ALL + own[i + 2]] += 1
    many = {w: x for w, x in contexts.items() if x.sum() > 2}
    assert got == {w: 1 + int(classlm.small_gains(x, classes[[classlm._group(w.encode()) - classlm.GROUPS]], n).argmax()) for w, x in many.items()} and len(got) > 60


def test_held_out_texts_gain_by_classes(spark):
    docs = spark.createDataFrame(sample(5, 1700), "doc_id long, text string, row int, word string")
    got = classlm.score(docs, F.col("doc_id") < 1500, size=60)[0].where("doc_id >= 1500").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.9 * got[1]


def test_gains_are_the_change_of_the_likelihood():
    """Of a word that doesn't follow itself or its own class."""
    n = np.random.default_rng(2).integers(1, 50, (classlm.ALL, classlm.ALL)).astype(float)
    x = np.zeros((1, 2 * classlm.ALL))
    x[0, [3, 4]], x[0, classlm.ALL + np.array([5, 6])] = (7, 2), (4, 5)
    for b in (1, 9, 20):
        with_it = n.copy()
        with_it[:, b] += x[0, : classlm.ALL]
        with_it[b] += x[0, classlm.ALL :]
        change = classlm.likelihood(with_it) - classlm.likelihood(n)
        marginal = sum(classlm._phi(a + k) - classlm._phi(a) for a, k in [(n.sum(axis=0)[5], 4), (n.sum(axis=0)[6], 5), (n.sum(axis=1)[3], 7), (n.sum(axis=1)[4], 2)])
        assert abs(classlm.gains(x, np.array([0]), n)[0, b - 1] - change - marginal) < 1e-6
        assert abs(classlm.gains(x, np.array([b]), with_it)[0, b - 1] - change - marginal) < 1e-6


def test_first_order_gains_choose_like_exact_ones():
    rng = np.random.default_rng(3)
    n = rng.integers(200, 50_000, (classlm.ALL, classlm.ALL)).astype(float)
    counts = rng.poisson(0.1, (200, 2 * classlm.ALL))
    own = rng.integers(1, classlm.ALL, 200)
    exact, first = classlm.gains(counts, own, n), classlm.small_gains(counts, own, n)
    assert np.abs((exact - exact[:, :1]) - (first - first[:, :1])).max() < 0.2
    assert (exact.argmax(axis=1) == first.argmax(axis=1)).mean() > 0.97


def test_rounds_rise_and_come_near_one_by_one_exchange(spark):
    rows = sample(2, 150)
    _, core, _, seqs, classes, n, risen = brute_model(spark, rows, 100)
    assert len(risen) > 2 and risen == sorted(set(risen)) and abs(risen[-1] - classlm.likelihood(n)) < 1e-6
    texts = [[core.get(w) or classlm._group(w) + len(core) + 1 for w in t.encode().split()] for _, t, _, _ in rows]

    def table(classes):
        out = np.zeros((classlm.ALL, classlm.ALL))
        for t in texts:
            own = [0, *(classes[i] for i in t), 0]
            np.add.at(out, (own[:-1], own[1:]), 1)
        return out

    assert (table(classes) == n).all()
    one = classlm.first_classes(core)
    first = best = classlm.likelihood(table(one))
    for item in range(1, len(core) + 1):  # each word in turn goes where the likelihood is highest
        for c in range(1, classlm.CLASSES + 1, 3):
            was, one[item] = one[item], c
            found = classlm.likelihood(table(one))
            best, one[item] = (found, c) if found > best else (best, was)
    assert risen[-1] - first > 0.8 * (best - first) > 0


def test_probabilities_sum_to_one_and_scores_match_them(spark):
    rows = [*sample(4, 60), (900, "b1 once0 twice twice", 1, "c"), (901, None, 1, "c"), (902, "", 1, "c")]
    counts, core, spelling, seqs, classes, n, _ = brute_model(spark, rows, 30)
    times = {r.word: r.n for r in counts.collect()}
    lexicon = classlm.lexicon_of(counts, classlm.other_classes(seqs, classes, n))
    spelled = lambda w: int(classes[classlm._group(w.encode()) - classlm.GROUPS])
    named = {w.decode(): int(classes[i]) for w, i in core.items()} | {r.word: r["class"] or spelled(r.word) for r in lexicon.collect()} | {classlm.END: 0}
    assert set(named) == set(times)
    frequent = np.array([times[classlm.END], *(times[w.decode()] for w in core)])
    less = classlm.discount(sum(c == 1 for c in times.values()), sum(c == 2 for c in times.values()))
    found = classlm.classed(seqs, lexicon, classes, frequent, sum(times.values()), len(times), less)
    n = classlm.class_bigrams(found)
    of = lambda keep: np.bincount([named[w] for w, c in times.items() if keep(c) and w != classlm.END], minlength=classlm.ALL)
    assert (np.bincount(classes[len(core) + 1 :], classlm.groups_once(counts), classlm.ALL) == of(lambda c: c == 1)).all()
    model = classlm.Model(n, of(bool), of(lambda c: c == 1), less)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    word = {w: model.word[named[w]] + math.log10(c - less) if w != classlm.END else 0.0 for w, c in times.items()}
    unseen = (of(lambda c: c == 1) + 1 / classlm.CLASSES) / (of(lambda c: c == 1).sum() + 1)
    assert abs(unseen[1:].sum() - 1) < 1e-9
    for c in set(named.values()):
        assert abs(sum(10 ** word[w] for w in named if named[w] == c) + (10 ** model.unseen[c] * unseen[c] if c else 0) - 1) < 1e-9, c
    assert np.allclose((10**spelling.table).sum(axis=1), 1)
    assert abs(spelling.known - sum(10 ** spelling.log([w.encode()])[0][0] for w in times if w != classlm.END)) < 1e-9
    likely, odd = spelling.share([b"once0", b"\xc3\xa4?="])  # so many words share 1 - ODD, and all other strings ODD
    assert abs(10**likely * spelling.unseen - (1 - classlm.ODD)) < 1e-9
    assert abs(odd - spelling.log([b"\xc3\xa4?="])[0][0] - math.log10(classlm.ODD / (1 - spelling.known))) < 1e-9
    new = [*rows, (903, "b1 Never a2 seen b1 b1", 1, "c"), (903, "b1 Never a2 seen b1 b1", 1, "c"), (None, "a1", 1, "c")]
    scored, tokens = classlm.score(spark.createDataFrame(new, "doc_id long, text string, row int, word string"), F.col("doc_id") < 903, size=30)
    got = [(r.doc_id, r.score, r.n_known) for r in scored.collect()]
    assert tokens == sum(times.values()) and len(got) == len(new)
    for i, text, _, _ in new:
        words = [*(text or "").lower().split(), classlm.END]
        own = [0, *(named.get(w) or (spelled(w) if w != classlm.END else 0) for w in words)]
        want = sum(model.transition[a, b] for a, b in zip(own, own[1:], strict=False)) + sum(word[w] if w in word else model.unseen[c] + spelling.share([w.encode()])[0] for c, w in zip(own[1:], words, strict=True))
        assert any(k == i and abs(s - want) < 1e-4 * max(1, abs(want)) and m == sum(w in times for w in words) for k, s, m in got), (i, want)


def test_no_training_rows_and_very_long_texts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "x y " * 60_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in classlm.score(df, F.lit(False))[0].collect()}
    assert rows[1].n_tokens == 3 and rows[1].n_known == 0 and math.isfinite(rows[1].score) and rows[1].base_score == 0
    rows = {r.doc_id: r for r in classlm.score(df, F.col("doc_id") == 2, size=1)[0].collect()}
    assert rows[2].n_tokens == 120_001 == rows[2].n_known and rows[2].score > -30 and rows[1].score < -2
    assert classlm.score(df.limit(0), F.lit(True))[0].count() == 0


def test_most_frequent_words(spark):
    df = spark.createDataFrame([(f"w{i:03}", n) for i, n in enumerate([1] * 50 + [2] * 10 + [100, 7, 7])], "word string, n long")
    assert classlm.most_frequent(df, 99) == sorted(((r.word, r.n) for r in df.collect()), key=lambda x: (-x[1], x[0]))
    assert classlm.most_frequent(df, 20) == [("w060", 100), ("w061", 7), ("w062", 7), *((f"w{i:03}", 2) for i in range(50, 60)), *((f"w{i:03}", 1) for i in range(7))]
    assert classlm.most_frequent(df, 2) == [("w060", 100), ("w061", 7)] and classlm.most_frequent(df, 0) == []
