import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folio.llm import flac, tokens

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 0), (1, 0), (1, 10**9), (1000, 10), (1000, 10**6), (3000, 3000)):
        values = np.sort(rng.integers(0, top + 1, n))
        own = tokens.EliasFano.encode(values)
        assert (own.all() == values).all() and [own.select(i) for i in range(n)] == values.tolist()
        if n >= 1000:
            bits = 8 * (own.lows.nbytes + own.highs.nbytes + own.samples.nbytes)
            assert bits <= n * (2.6 + max(0.0, np.log2(max(1, top / n)) + 1)) + 64
    with pytest.raises(IndexError):
        own.select(n)


def test_files_round_trip(spark, tmp_path):
    texts = ["Hello, World's end!", None, "", " \n", "Don't <|endoftext|>stop", "x" * 3000, "Ünï cödé ½ ﬁ\x1cab", "same", "same", "a b " * 5000]
    rows = [(100 - i, t, "clash") for i, t in enumerate(texts)] + [(None, "null id", "c"), (95, "again", "c")]
    path = f"file://{tmp_path}/tokens"
    tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string, id string"), path, PATH, 2)
    got = tokens.read_with_offsets(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    library, at = Tokenizer.from_file(PATH), 0
    by_id = {}
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        by_id.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert (r.n_tokens, r.ids_crc32) in by_id[r.doc_id] and r.start == at
        at += r.n_tokens
    block = tokens.Block(bytes(spark.read.parquet(path).first().data))
    ends = block.ends.all()
    assert all((block.document(i) == block.tokens[(ends[i - 1] if i else 0) : ends[i]]).all() for i in range(len(ends)))


def test_no_documents(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH, 2)
    assert tokens.read_with_offsets(spark, path).count() == 0


def _bits(*fields):
    out = "".join(format(v & (1 << n) - 1, f"0{n}b") for v, n in fields)
    return out


def _frame(number, size, code, depth_code, body):
    head = bytes([0xFF, 0xF8, 0x70, code << 4 | depth_code << 1, number]) + (size - 1).to_bytes(2, "big")
    head += bytes([flac.crc8(head)])
    body += "0" * (-len(body) % 8)
    raw = head + int(body, 2).to_bytes(len(body) // 8, "big")
    return raw + int(flac.crc16s(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0]).to_bytes(2, "big")


def _stream(frames, channels, depth, total):
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | channels - 1 << 41 | depth - 1 << 36 | total).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + b"".join(frames)


def _rice(values, k):
    return "".join("0" * (u >> k) + "1" + (format(u & (1 << k) - 1, f"0{k}b") if k else "") for v in values for u in [v * 2 if v >= 0 else -v * 2 - 1])


def test_foreign_streams():
    """LPC, partitions, escapes, wide parameters, wasted bits, constants and mid/side stereo, from a writer of the test's own."""
    rng = random.Random(4)
    n, coef, shift = 32, [3, -2], 1
    x = [5, 7]
    errors = [rng.randint(-40, 40) for _ in range(n - 2)]
    for e in errors:
        x.append(e + ((coef[0] * x[-1] + coef[1] * x[-2]) >> shift))
    x = [v for v in x]
    depth = 24
    lpc = _bits((0, 1), (32 + 1, 6), (0, 1), (5, depth), (7, depth), (3, 4), (shift, 5), (3, 4), (-2, 4))
    parts = _bits((1, 2), (1, 4), (4, 5)) + _rice(errors[:14], 4) + _bits((31, 5), (8, 5)) + "".join(format(e & 255, "08b") for e in errors[14:])
    frames = [_frame(0, n, 0, 6, lpc + parts)]
    got = flac.decode([_stream(frames, 1, depth, n)])[0]
    assert got.samples[0].tolist() == x and got.blocks == [(0, n)]

    left, right = [rng.randint(-90, 90) for _ in range(20)], [rng.randint(-90, 90) for _ in range(20)]
    mid, side = [(a + b) >> 1 for a, b in zip(left, right, strict=True)], [a - b for a, b in zip(left, right, strict=True)]
    verbatim = _bits((0, 1), (1, 6), (0, 1)) + "".join(format(v & 255, "08b") for v in mid)
    fixed = _bits((0, 1), (9, 6), (0, 1), (side[0], 9), (0, 2), (0, 4), (5, 4)) + _rice([b - a for a, b in zip(side, side[1:], strict=False)], 5)
    wasted = _bits((0, 1), (8, 6), (1, 1), (1, 2), (0, 2), (0, 4), (2, 4)) + _rice([v // 4 for v in [8, -4, 12, 0]], 2)  # two wasted bits
    constant = _bits((0, 1), (0, 6), (0, 1), (-3, 8))
    frames = [_frame(0, 20, 10, 1, verbatim + fixed), _frame(1, 4, 1, 1, wasted + constant)]
    got = flac.decode([_stream(frames, 2, 8, 24)])[0]
    assert got.samples.tolist() == [left + [8, -4, 12, 0], right + [-3] * 4] and got.blocks == [(0, 20), (20, 4)]


def test_damage_is_found():
    good = flac.encode([b"some text " * 300])[0]
    assert flac.decode([good])[0].pcm == b"some text " * 300
    for at in (0, 45, 120, len(good) // 2, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(flac.FlacError):
            flac.decode([bytes(bad)])
    with pytest.raises(flac.FlacError):
        flac.decode([good[:-3]])


def test_media_columns(spark):
    rng = random.Random(5)
    texts = ["", None, "abc", "é" * 700, "".join(chr(rng.randint(32, 0x2FF)) for _ in range(5000)), "a" * 4096, "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = flac.flac_encode(df, "doc_id", "text")
    rows = flac.flac_decode(coded.withColumn("pcm", F.lit("clash"))).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        raw = (t or "").encode()
        assert bytes(r.pcm) == raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)) and r.n_bytes == len(raw)
        assert sum(b.n_samples for b in r.blocks) == len(r.pcm) and [b.sample_offset for b in r.blocks] == [b.byte_offset for b in r.blocks]
    assert rows[6].media == rows[7].media and rows[6].feature == rows[7].feature
    assert hashlib.md5(bytes(b ^ 0x80 for b in bytes(rows[2].pcm))).digest() in bytes(rows[2].media)
    assert flac.flac_decode(coded.limit(0)).count() == 0
    assert flac.flac_decode(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first().pcm is None


def test_writer_takes_linear_predictors_and_quarters(spark):
    n = np.arange(40_000)
    rng = np.random.default_rng(1)
    wave = (128 + 100 * np.sin(n / 9) + rng.normal(0, 2, len(n))).clip(0, 255).astype(np.uint8).tobytes()
    loud = (128 + np.where(n % 1024 < 512, 1, 40) * rng.normal(0, 0.5, len(n))).clip(0, 255).astype(np.uint8).tobytes()
    payloads = [wave, loud, bytes(64), bytes(range(256)) * 4, rng.bytes(5000), b"x", b"ab", b"abc", b"", b"\xff\x00" * 700]
    media = flac.encode(payloads)
    assert [s.pcm for s in flac.decode(media)] == payloads

    def kinds(data):
        """(kind of subframe, order of partitions) of each frame."""
        for p in flac.Stream(data, 0).starts():
            q = flac._header(data, p, 8)[0]
            kind = data[q] >> 1 & 63
            at = (q + 1) * 8 + 8 * flac.LPC + 9 + flac.LPC * flac.PRECISION + 2 if kind >= 32 else (q + 1) * 8 + 8 * (kind & 7) + 2
            yield kind, flac._Bits(data).one(at, 4)

    assert [k for k, _ in kinds(media[0])].count(31 + flac.LPC) == 39
    assert len(media[0]) < 0.55 * len(wave)
    assert 2 in {p for _, p in kinds(media[1])} and len(media[1]) < 0.65 * len(loud)
    docs = flac.flac_encode(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text").collect()
    found = [k for r in docs for k, _ in kinds(bytes(r.media))]
    assert found.count(31 + flac.LPC) > len(found) / 4  # the rows of the test tables pass the linear predictor too


def test_damaged_rows(spark):
    good = flac.encode([b"some text " * 300])[0]
    bad = good[:-9] + b"x" + good[-8:]
    df = spark.createDataFrame([(1, good, "clash"), (2, bad, "c"), (3, None, "c"), (4, b"no flac", "c"), (5, good, "c")], "doc_id long, media binary, damage string")
    rows = {r.doc_id: r for r in flac.flac_decode(df, damaged=True).collect()}
    assert [i for i, r in rows.items() if r.pcm is None] == [2, 3, 4] and bytes(rows[5].pcm) == b"some text " * 300
    assert rows[1].damage is None and rows[3].damage is None and "CRC" in rows[2].damage and "FLAC" in rows[4].damage


def test_op3_columns(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = flac.op3_flac(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id]
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = flac.encode([full])[0]
        want = (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), len(media), hashlib.sha256(media).hexdigest())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == want


def test_op2_columns(spark):
    library, at = Tokenizer.from_file(PATH), 0
    rows = {r.doc_id: r for r in tokens.op2_token_files(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        assert (rows[r.doc_id].start, rows[r.doc_id].n_tokens, rows[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = tokens.WordIds(path)
    assert not own.by_word and tokens.WordIds(PATH).by_word
    for text in ("Hello,  World's end!\n\n x", "", "é½"):
        assert np.frombuffer(own.encode(text.encode()), f"<u{own.width}").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
