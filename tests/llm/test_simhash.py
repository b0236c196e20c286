import random

import numpy as np
import xxhash

from folio.llm import simhash
from folio.llm.graph import components

SCHEMA = "doc_id long, text string, fp string, component_id int"


def plain(text):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\n", " ").replace("\t", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def reach(prints, ids):
    f = np.array(prints, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    label = np.arange(len(f))
    while True:
        new = np.where(near, label[None, :], len(f)).min(axis=1)
        if (new == label).all():
            break
        label = new
    return [min((ids[j] for j in range(len(ids)) if label[j] == label[i] and ids[j] is not None), default=None) for i in range(len(ids))]


def test_fingerprints_and_components_match_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(60)]
    texts += [t + " tail" for t in texts[:20]] + texts[:15] + [None, "", " \t", "Élan ÉLAN élan", "one", "ONE", "two words", "x " * 40000]
    rows = [(i if i != 61 else None, t, "clash", 7) for i, t in enumerate(texts)]
    rows.append(rows[3])
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = [plain(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], prints, reach(prints, [r[0] for r in rows]), strict=True), key=str)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=str) == want


def test_every_pair_within_three_bits_shares_a_key_and_large_groups_are_linked(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(4)} | set(base)
    dense = {base[0] ^ (i << 20) for i in range(1200)}  # one group of many: consecutive numbers differ in few bits
    prints = sorted(near | dense)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(df)).collect()}
    got = [roots.get(x, x) for x in signed]
    want = reach(prints, list(range(len(prints))))
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (201, 200), (5, 5)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, 201: 200}


def test_op1_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    prints = [plain(r.text) for r in docs]
    want = {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(docs, prints, reach(prints, [r.doc_id for r in docs]), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, "/root/testdata/sf0.001").collect()} == want
