import random
from itertools import combinations

import corpus_pipeline

from folio.llm import nearcopies, simhash


def plain(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """The ids that aren't the smallest of their group, by comparing all pairs."""
    sets, root = {i: plain(t or "") for i, t in rows}, {i: i for i, _ in rows}
    for a, b in combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return {i: r for i, r in root.items() if i != r}


def made(seed, changes):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(90, 200))
        texts.append(base)
        for n in changes:
            other = list(base)
            for at in rng.sample(range(len(base)), n):
                other[at] = rng.choice(words)
            texts.append(other)
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9000, None), (9001, ""), (9002, "two words"), (9003, "Two  WORDS"), (9004, "a b c d e f")]


def test_groups_match_brute_force(spark):
    rows = made(4, [1, 1, 2, 2, 3, 4, 6, 9])
    # a chain of two-word steps: far ends are below 0.8, and each key's smallest id isn't near to all
    words = [f"c{i}" for i in range(120)]
    for step in range(12):
        rows.append((5000 - step, " ".join(words)))
        words[step * 10 : step * 10 + 2] = [f"x{step}", f"y{step}"]
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    want = brute(rows)
    assert len(want) > 30
    assert {r.node: r.root for r in nearcopies.groups(docs).collect()} == want


def test_large_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 4)
    rows = made(5, [1, 2, 2, 3, 3, 4, 5, 7])
    assert {r.node: r.root for r in nearcopies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)


def test_pipeline_drops_copies_with_changed_words(spark):
    """SimHash leaves these: they differ in more than 3 bits."""
    rows = [(i, t) for i, t in made(6, [2]) if i < 9000]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = {i for i, _ in rows} - set(brute(rows))
    assert len({r.component_id for r in simhash.near_duplicates(docs).collect()}) > len(want)
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == want
    assert dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs.limit(0), "").count() == 0


def test_pairs_of_a_large_family_are_never_rows(spark, monkeypatch):
    """Texts that are alike, few of them at 0.8: the tables between the steps grow with the texts, not with their pairs."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(130)]
    rows = []
    for i in range(300):
        other = list(base)
        for at in rng.sample(range(len(base)), rng.choice([1, 2, 3, 4, 5, 5])):
            other[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(other)))
    rows += [(1000 + i, t) for i, t in rows[::3]] + [(2000, " ".join(base))]
    sizes = {}

    def seen(df, name):
        out = materialize(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    materialize = nearcopies.materialize
    monkeypatch.setattr(nearcopies, "materialize", seen)
    want = brute(rows)
    assert {r.node: r.root for r in nearcopies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    assert len(want) > 100
    assert max(sizes.values()) <= nearcopies.BANDS * 301 and sizes["near"] <= 8 * 301 and sizes["more"] <= 301
