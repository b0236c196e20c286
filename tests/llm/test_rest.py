import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folio.llm import decontaminate, html, pieces, rollup, toxicity

SF = "/root/testdata/sf0.001"


def oracle(sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.sql(sql)


def same(df, sql):
    own = oracle(sql)
    names = sorted(df.columns)
    assert names == sorted(own.columns)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, own.project(", ".join(f'"{n}"' for n in names)).fetchall()))


def test_leaks_match_sql(spark):
    same(decontaminate.op6_decontaminate(spark, SF), decontaminate.ORACLE)


def test_templates(spark):
    item = "A train moves 120 km in 2 hours near Paris. How far does it go in 5 hours?"
    rows = [
        (1, "Well, " + item), (2, "A train moves 90 km in 3 hours near Rome. How far does it go in 7 hours?"), (3, "A train moves 90 km in 3 hours near Rome. How far does it go in 3 hours?"),
        (4, None), (None, item), (5, ""), (6, "A truck moves 120 km in 2 hours near Paris and stops"), (1, "Well, " + item), (7, "x " * 30000 + item), (8, "before. Short one two three four. after"), (9, "Short one two"),
    ]
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id long, text string, item_id string, h int")
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (None, item), (9, "Short one two three four."), (10, "Tiny")], "item_id int, text string")
    got = {(r.doc_id, r.item_id): (r.changed, r.coverage) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {(1, 7): (0, 1.0), (2, 7): (4, 1.0), (7, 7): (0, 1.0), (8, 9): (0, 1.0)}
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0


def leaks_and_sql(spark, tmp_path, docs, items):
    """{(doc, item): (changed, coverage)}, the same by SQL."""
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = {(a, b): (c, d) for a, b, c, d in con.sql(f"select doc_id, item_id, changed, coverage from ({decontaminate.ORACLE})").fetchall()}
    got = {(r.doc_id, r.item_id): (r.changed, r.coverage) for r in decontaminate.op6_decontaminate(spark, str(tmp_path)).collect()}
    assert got == want
    return got


def test_names_that_begin_sentences_and_names_of_two_words(spark, tmp_path):
    item = "Tom has 5 apples. Tom gives 2 to Ann. How many has Tom left?"
    docs = [
        (1, "Sam has 7 apples. Sam gives 3 to Eve. How many has Sam left?"), (2, "Sam Lee has 7 apples. Sam Lee gives 3 to Eve. How many has Sam Lee left?"),
        (3, "Sam has 7 apples. Ben gives 3 to Eve. How many has Tim left?"), (4, "The cook has 7 apples. The cook gives 3 to Eve. How many has Sam left?"),
    ]
    assert leaks_and_sql(spark, tmp_path, docs, [(1, item)]) == {(1, 1): (4, 1.0), (2, 1): (4, 1.0)}


def test_short_items_and_items_without_words(spark, tmp_path):
    items = [(1, "Two plus two makes?"), (2, "Tiny"), (3, "7 + 5 ="), (4, " ".join(map(str, range(20)))), (5, "?!")]
    docs = [(1, "They ask: two plus two makes? Nobody knows."), (2, "A tiny text."), (3, "tiny"), (4, "Tiny"), (5, "7 5"), (6, "8 5"), (7, "it is 7 + 5 = 12"), (8, " ".join(map(str, range(20)))), (10, "?!"), (11, "x 1 " * 50)]
    assert leaks_and_sql(spark, tmp_path, docs, items) == {(1, 1): (0, 1.0), (4, 2): (0, 1.0), (5, 3): (0, 1.0), (8, 4): (0, 1.0)}


def test_long_tables_of_numbers_end(spark):
    numbers = " ".join(str(i * 7919 % 10**6) for i in range(20_000))
    docs = spark.createDataFrame([(1, numbers), (2, numbers), (3, "x 1 " * 10_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(map(str, range(20)))), (2, "the sum of x 1 x 2 x 3 x 4 x 5 x 6 is what")], "item_id long, text string")
    assert decontaminate.find_leaks(docs, items).count() == 0


def test_recall_with_inserted_words(spark):
    rng = random.Random(9)
    words = [f"word{c}{d}" for c in "abcdefgh" for d in "xyzuvw"]
    items = [(i, " ".join(rng.choices(words, k=24))) for i in range(20)]
    docs = []
    for i, text in items:
        for n in range(1, 4):
            own = text.split()
            for at in sorted(rng.sample(range(1, len(own)), n), reverse=True):
                own.insert(at, "inserted")
            docs.append((10 * i + n, " ".join([*rng.choices(words, k=30), *own, *rng.choices(words, k=30)])))
    found = {r.doc_id for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    rates = [sum(10 * i + n in found for i, _ in items) / len(items) for n in range(1, 4)]
    assert rates[0] == 1 and rates[1] > 0.2 and found.isdisjoint({10 * i for i, _ in items}), rates  # half of the windows must be whole


def test_no_python_in_the_leak_plan(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = decontaminate.document_windows(docs, "doc_id", "text", [8, 5], True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b < c", "a b < c"), ("<p>a&amp;b &lt;i&gt; &#233;&nbsp;x</p>", "a&b <i> é x"),
        ("<html><body><nav>menu</nav><div class='cookie-notice'>We use</div><article><h1>T</h1><p>One <b>t</b>wo</p><ul><li>x<li>y</ul></article><aside>s</aside><footer>f</footer></body></html>", "T One two x y"),
        ("<body><script>var a='<p>no</p>'</script><style>p{}</style><!-- no <p> --><p>yes</p></body>", "yes"),
        ("<body><div id=main><p>" + "long text here and more of it. " * 9 + "</p><p>" + "second part of it all. " * 9 + "</p></div><div><a href=1>l1</a><a href=2>l2</a><a href=3>l3</a></div></body>", ("long text here and more of it. " * 9 + "second part of it all. " * 9).strip()),
        ("<article><p>a<form><input value=x>f</form><div class=comments><p>no</div><p>b</article>", "a b"),
        ("<title>t</title><textarea>x</textarea><p>a<br>b<td>c", "a b c"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("</p></div>x</body>", "x"), ("<p>unclosed <!-- comment", "unclosed"), ("<p title='a>b'>q</p><script>", "q"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


def test_pages(spark):
    got = html.extract(spark.createDataFrame([(1, "u", "<p>a</p>", "clash"), (2, None, None, "c"), (1, "u", "<p>a</p>", "clash")], "page_id long, url string, html string, text string"))
    assert sorted(map(str, ((r.page_id, r.text, r.n_chars) for r in got.collect()))) == sorted(map(str, [(1, "a", 1), (2, "", 0), (1, "a", 1)]))
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
    pages = html.op7_html(spark, SF)
    assert pages.count() == spark.read.parquet(f"{SF}/pages.parquet").count() and pages.where("n_chars = 0").count() == 0


def test_pieces_match_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    own = pieces.Pieces(pieces.model_path())
    rng = random.Random(6)
    texts = ["", "a", "  lead", "tail  ", "a  b\nc\td", "日本語 テキスト 😀", "<s> <0x0A> <unk>", "é" * 50, "\n\n", "▁mark▁", "x" * 500, "\u0000 ​ ﬁ①"]
    texts += ["".join(rng.choice("abcdefghij    ABC.,é\n") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == library.encode(text), text
        assert own.decode(ids) == library.decode(ids.tolist())
        if "▁" not in text:
            assert own.decode(ids) == text


def test_op8_columns(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rows = {r.doc_id: r for r in pieces.op8_pieces(spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for i, text in texts.items():
        ids, r = library.encode(text), rows[i]
        decoded = library.decode(ids)
        assert (r.n_tokens, r.ids_crc32, r.decoded_sha256, r.same) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(decoded.encode()).hexdigest(), decoded == text)


def test_unigram_way_is_the_best_sum():
    own = pieces.Pieces(pieces.model_path(), "unigram")
    rng = random.Random(7)
    own.score = {p: rng.uniform(-9, -1) for p in own.score if len(p) <= 3}
    own.worst = -30.0

    def best(word):
        found = {0: 0.0}
        for end in range(1, len(word) + 1):
            found[end] = max(found[s] + (own.score[word[s:end]] if word[s:end] in own.score else own.worst) for s in range(end) if word[s:end] in own.score or end - s == 1)
        return found[len(word)]

    words = {"▁" + "".join(rng.choice("abéz日") for _ in range(rng.randint(0, 9))) for _ in range(200)}
    own.learn(words)
    assert set(own.known) == words
    for word in words:
        ids = np.frombuffer(own.known[word], "<u4").tolist()
        if all(c in own.id for c in word):
            assert abs(sum(own.score[own.text[i]] if own.text[i] in own.score else own.worst for i in ids) - best(word)) < 1e-6


def test_piece_columns(spark):
    df = spark.createDataFrame([(1, "ab c", "clash"), (2, None, "x"), (1, "ab c", "clash")], "doc_id long, text string, ids string")
    rows = pieces.decode(pieces.encode(df, pieces.model_path()), pieces.model_path()).orderBy("doc_id").collect()
    assert [(r.doc_id, r.decoded, r.n_tokens > 0) for r in rows] == [(1, "ab c", True), (1, "ab c", True), (2, "", False)]
    assert pieces.encode(df.limit(0), pieces.model_path()).count() == 0


def recounted(rows):
    """Totals by plain recounting: one row of each text, by the least source and language."""
    words, piece = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    kept, out = {}, {}
    for _, text, source, lang in rows:
        key = lambda x: tuple((v is not None, v or "") for v in x)
        kept[text or ""] = min((source, lang), kept.get(text or "", (source, lang)), key=key)
    for text, (source, lang) in kept.items():
        for version, n in (("word_bpe_49k", len(words.encode(text, add_special_tokens=False).ids) + 1), ("piece_bpe_32k", len(piece.encode(text)))):
            docs, total = out.get((source, lang, version), (0, 0))
            out[source, lang, version] = docs + 1, total + n
    return out


def test_rollup_matches_a_recount(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "lang")
    odd = [(1, "a b", "s", "en"), (1, "a b", "s", "en"), (None, "only null id", "s", None), (2, "c", None, None), (None, None, "t", "en"), (3, "", "s", "en"), (4, "c", "s", "en"), (None, "c", "s", "en")]
    for i, df in enumerate((docs, spark.createDataFrame(odd, docs.schema), docs.limit(0))):
        df.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        got = rollup.op9_token_rollup(spark, f"{tmp_path}/{i}").collect()
        assert {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in got} == recounted(map(tuple, df.collect())) and len(got) == len({tuple(r)[:3] for r in got})


def test_rollup_commits_once(spark, tmp_path):
    own = rollup.Rollup(spark, f"file://{tmp_path}/r")
    assert own.totals().count() == 0
    facts = spark.createDataFrame([("a", "en", "v1", 3, 5, "x"), ("a", "en", "v1", 4, 4, "x"), (None, None, "v1", None, 2, "x")], "source string, lang string, version string, tokens long, new long, docs string")
    assert own.commit("1", rollup.inserts(facts)) and not own.commit("1", rollup.inserts(facts))
    read = lambda: {(r.source, r.lang): (r.docs, r.tokens) for r in own.totals().collect()}
    assert read() == {("a", "en"): (2, 7), (None, None): (1, 0)}
    own.commit("2", rollup.revisions(facts, "tokens", "new"), rollup.deletes(facts.limit(0)))
    assert read() == {("a", "en"): (2, 9), (None, None): (1, 2)}
    own.commit("3", rollup.deletes(facts.where("source is null"), "new"))
    assert read() == {("a", "en"): (2, 9)}
    spark.createDataFrame([("a", "en", "v1", 9, 9)], rollup.SCHEMA).write.parquet(f"file://{tmp_path}/r/batch=4")  # a commit that failed
    assert read() == {("a", "en"): (2, 9)}
    assert own.commit("4", rollup.inserts(facts.limit(0))) and read() == {("a", "en"): (2, 9)}
    packed = own.compact(f"file://{tmp_path}/s")
    assert {(r.source, r.docs, r.tokens) for r in packed.totals().collect()} == {("a", 2, 9)}


def test_toxicity_finds_insults(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = rng.choices(words, k=rng.randint(5, 60))
        toxic = i % 4 == 0
        for _ in range(rng.randint(1, 4) if toxic else 0):
            text.insert(rng.randint(0, len(text)), rng.choice(["idiot", "grumbo", "grumbos", "sc*m"]))
        rows.append((i, " ".join(text), "clash", 1.0))
        labels.append((i, int(toxic), None))
    rows += [(900, None, "c", 1.0), (901, "", "c", 1.0), (None, "you idiot, grumbo!", "c", 1.0), (3, rows[3][1], "c", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, score double").cache()
    marks = spark.createDataFrame([*labels, (5, None, 1), (None, 1, 1), (7, 0, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, marks, F.col("doc_id") % 5 != 0)
    assert "grumbo" in model.words or "grum" in model.starts
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 5 == 0]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.93
    assert toxicity.score(docs.limit(0), model).count() == 0
    # insults that only the labels teach, held out
    own = [r for r in held if "grumbo" in rows[r.doc_id][1] and not {"idiot", "sc*m"} & set(rows[r.doc_id][1].split())]
    assert len(own) > 5 and np.mean([r.predicted for r in own]) > 0.8
    # calibration: the score follows the trees' probability and never falls
    made = toxicity.with_features(docs, model.words, model.starts, keep=["doc_id", "text"])
    raw = model.trees.transform(toxicity._assembled(made)).select("row.doc_id", toxicity.vector_to_array("probability")[1].alias("p")).collect()
    points = sorted({(r.p, s.score) for r in raw for s in got if s.doc_id == r.doc_id and r.doc_id is not None and r.doc_id != 3})
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(points, points[1:], strict=False)) and len({s for _, s in points}) > 1


def test_features_by_plain_counting():
    rng = random.Random(10)
    words, starts = {"grumbo": 2.0, "zonk": 3.0}, {"grum": 1.5, "grumb": 1.0}
    vocabulary = ["You", "are", "an", "IDIOT", "grumbo", "zonk!", "1d10t", "the", "cat,", "tu", "Grumbos", "sc*m", "fine.", "42", "é"]
    for _ in range(200):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 25)))
        got = dict(zip(toxicity.FEATURES, toxicity.features(text, words, starts), strict=True))
        low = re.findall(r"\w+", text.lower())
        n = max(1, len(low))
        seed = [i for i, w in enumerate(low) if w in toxicity.SEED_WORDS]
        person = [i for i, w in enumerate(low) if w in toxicity.SECOND_PERSON]
        bad = [i for i, w in enumerate(low) if w in words or w in toxicity.SEED_WORDS]
        near = sum(any(abs(i - j) <= toxicity.NEAR for j in person) for i in bad)
        begun = sum(1.5 for w in low if w.startswith("grum"))
        letters = [c for c in text if c.isascii() and c.isalpha()]
        want = {
            "seed_density": 100 * len(seed) / n, "learnt_density": 100 * sum(words.get(w, 0) for w in low) / n, "learnt_most": max((words[w] for w in low if w in words), default=0.0),
            "start_density": 100 * begun / n, "near_density": 100 * near / n, "person_density": 100 * len(person) / n,
            "capitals": sum(c.isupper() for c in letters) / max(1, len(letters)), "exclamation": 100 * text.count("!") / n,
            "punctuation": sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in text) / max(1, len(text)), "repetition": len(set(low)) / n,
        }
        assert {k: round(got[k], 9) for k in want} == {k: round(v, 9) for k, v in want.items()}, text


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for labels, want in (([], 0.0), ([(1, 1)], 1.0), ([(1, 0)], 0.0)):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
        assert {r.score for r in toxicity.score(docs, model).collect()} == {want}


def test_held_out_toxicity():
    assert len(toxicity.features("", {}, {})) == len(toxicity.FEATURES)
    low = toxicity.features("You are an idiot! 1d10t", {}, {})
    named = dict(zip(toxicity.FEATURES, low, strict=True))
    assert named["near_density"] > 0 and named["obfuscated_hits"] == 1 and named["seed_hits"] > 0
