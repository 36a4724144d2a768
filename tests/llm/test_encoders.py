"""SentencePiece, token output and TIFF: against the libraries and by exact round trips."""

import random
import zlib
from array import array
from hashlib import sha256

import numpy as np
import pytest
from public_tokenizers import path as tokenizer

from skein.llm import media_tiff, sentencepiece_bpe, token_output

ODD = [None, "", " ", "a", "  two  spaces ", "▁mark", "line\nfeed\r\n\ttab", "é́ñ中梦🙂", "<s></s><unk><0x41><|endoftext|>", "x<|endoftext|>y", "İstanbul ΣΑΣ", "\x00\x1c\x85\xa0z", "a" * 3000, "word " * 3000, " " * 300, "don't 's 12 3½"]
ROWS = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "no id", "x"), (3, "a", "x"), (3, "a", "x")]


def table(spark, rows=ROWS):
    """With a column whose name clashes with those of results."""
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


@pytest.fixture(scope="module")
def encoder():
    return sentencepiece_bpe.Encoder(tokenizer("piece_bpe_32k.model"))


def noise(n, seed=1):
    rng = random.Random(seed)
    alphabet = "  ▁\n\tabcdefghtheing123.,;:🙂é中ñ梦́<s>'\xa0Σ"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_prefix_table_equals_library(encoder):
    texts = [t or "" for t in ODD] + noise(4000) + ["a" + " " * n + "the" for n in range(40)]
    for text, ids in zip(texts, encoder.library.encode(texts, add_bos=True, add_eos=True), strict=True):
        assert list(array("I", encoder.encode(text))) == ids, text


def test_prefix_table_forgets_and_agrees(encoder, monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "WORDS", 5)
    monkeypatch.setattr(sentencepiece_bpe, "PAIRS", 5)
    for text in noise(200, 3):
        assert list(array("I", encoder.encode(text))) == encoder.library.encode(text, add_bos=True, add_eos=True)


def test_encode_documents(spark, encoder):
    found = sentencepiece_bpe.encode_documents(table(spark), tokenizer("piece_bpe_32k.model")).collect()
    assert sorted(map(str, (r.doc_id for r in found))) == sorted(map(str, (r[0] for r in ROWS)))
    by_id = {r.doc_id: r for r in found}
    for i, text, _ in ROWS:
        ids = encoder.library.encode(text or "", add_bos=True, add_eos=True)
        r = by_id[i]
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded == encoder.library.decode(ids) and r.decoded_sha256 == sha256(r.decoded.encode()).hexdigest()
    assert sentencepiece_bpe.encode_documents(table(spark, []), tokenizer("piece_bpe_32k.model"), ids=False).count() == 0


def test_wordwise_equals_library():
    words = token_output.WordwiseTokenizer(tokenizer("word_bpe_49k.json"))
    texts = [t or "" for t in ODD] + noise(4000, 2) + ["J̌ ǰ क़x क़, İ, σİ| Ⅷ² x.y don't. 'tis"]
    for text, ids, want in zip(texts, words.encode_all(texts), words.library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert list(array("i", ids)) == want.ids, text


def test_orc_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    found = {(r.doc_id, r.start): r for r in token_output.tokenize_to_orc(table(spark), tokenizer("word_bpe_49k.json"), path=path).collect()}
    library = token_output.WordwiseTokenizer(tokenizer("word_bpe_49k.json")).library
    at = 0
    for i, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        r = found[i, at]
        assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert len(found) == len(ROWS)
    one = token_output.read_ids(spark, path).where("doc_id = 5")
    assert one.count() == 1 and "EqualTo(doc_id,5)" in one._jdf.queryExecution().toString()
    assert token_output.tokenize_to_orc(table(spark, []), tokenizer("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("codec", media_tiff.CODECS)
@pytest.mark.parametrize("order", "<>")
def test_tiff_round_trip(codec, order):
    rng = np.random.default_rng(0)
    pages = [rng.integers(0, 256 if h < 50 else 4, (h, w), dtype=np.uint8) for h, w in ((1, 1), (33, 70), (200, 100))]
    for predictor in (False, True):
        for tile in (0, 16):
            stored = media_tiff.write_pages(pages, codec, predictor, rows=7, tile=tile, order=order)
            found = list(media_tiff.read_pages(stored))
            assert [p.page for p in found] == [0, 1, 2]
            for p, want in zip(found, pages, strict=True):
                assert (p.data[:, :, 0] == want).all() and p.tiled == bool(tile) and p.predictor == 1 + predictor


def test_codecs_long_and_empty():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 70_000):
        for top in (1, 3, 256):
            data = rng.integers(0, top, n, dtype=np.uint8).tobytes()
            assert media_tiff.lzw_decode(media_tiff.lzw_encode(data)) == data
            assert media_tiff.unpack_bits(media_tiff.pack_bits(data)) == data
    assert media_tiff.unpack_bits(b"\xfe\xaa\x02\x80\x00\x2a\xfd\xaa\x03\x80\x00\x2a\x22\xf7\xaa") == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa")  # the format's own example
    assert media_tiff.lzw_decode(bytes.fromhex("800B6050220C0C8501")) == bytes.fromhex("2d2d2d2d2d412d2d2d42")


def test_tiff_pages(spark):
    good = media_tiff.write_pages([np.zeros((3, 4), np.uint8), np.ones((2, 2), np.uint8)])
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, b"no image"), (5, good[:-9]), (None, good)]
    found = media_tiff.tiff_pages(spark.createDataFrame(rows, "id long, blob binary"), "id", "blob").collect()
    assert sorted((r.id, r.page) for r in found if r.id in (1,)) == [(1, 0), (1, 0), (1, 1), (1, 1)]
    assert {r.id for r in found if r.error} == {4, 5} and not [r for r in found if r.id in (2, 3)]
    assert {bytes(r.data) for r in found if r.page == 1 and r.id == 1} == {b"\x01" * 4}


def test_texts_as_tiff(spark):
    found = media_tiff.texts_as_tiff(table(spark), media=True).collect()
    assert len(found) == len(ROWS)
    by_id = {r.doc_id: r for r in found}
    for i, text, _ in ROWS:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = by_id[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == sha256(r.media).hexdigest()
        assert b"".join(p.data.tobytes() for p in media_tiff.read_pages(bytes(r.media))) == payload
    assert by_id[0].feature == by_id[1].feature


def test_words_are_encoded_once(monkeypatch):
    encoder = sentencepiece_bpe.Encoder(tokenizer("piece_bpe_32k.model"))
    calls = []
    plain = encoder._word
    monkeypatch.setattr(encoder, "_word", lambda word: calls.append(word) or plain(word))
    text = "qwzu qwzu, qwzu. ,qwzu; qwzu"
    assert encoder.encode(text) == np.array(encoder.library.encode(text, add_bos=True, add_eos=True), "<u4").tobytes()
    want = [m + w for m, w in (("▁", "qwzu"), ("", ","), ("", "."), ("▁", ",qwzu"), ("", ";"))]
    assert calls == [w for w in want if len(w) > 1 or "u" + w not in encoder.inside]
    monkeypatch.setattr(sentencepiece_bpe, "WORDS", 1)
    encoder.spaced.clear()
    calls.clear()
    encoder.encode("xaab xbba xaab")  # the full table is the old one now
    assert calls == ["▁xaab", "▁xbba"]


def test_compatible_pairs_are_those_of_the_definition():
    encoder = sentencepiece_bpe.Encoder(tokenizer("piece_bpe_32k.model"))
    tokens = sorted(encoder.before)[:: len(encoder.before) // 120]
    for a in tokens:
        for b in tokens:
            left, right = encoder.piece[a], encoder.piece[b]
            assert encoder._compatible(a, b) == (encoder._merged(left + right) == [left, right])
