"""Encoding and decoding against the library, exactly."""

import hashlib
import random

import pytest

from brindle.llm import pieces
from brindle.llm.queries import piece_model

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.Pieces(piece_model()))


def test_texts_at_random(library, encoder):
    r = random.Random(1)
    signs = [" ", " ", "\n", "a", "e", "t", "th", "er", "▁", "É", "日", "𝒳", "\x00", ".", ",", "<", "1", "the", "ing", "\t", "  ", "</s>", "<0x41>", "***"]
    for _ in range(8000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 24)))
        want = library.encode(text, add_eos=True)
        assert encoder.encode(text) == " ".join(map(str, want))
        assert encoder.pieces.decode(want) == library.decode(want)


def test_ids_at_random(library, encoder):
    r = random.Random(2)
    for _ in range(4000):
        ids = [r.randrange(32000) if r.random() < 0.5 else r.randrange(259) for _ in range(8)]
        assert encoder.pieces.decode(ids) == library.decode(ids)


def test_long_runs(library, encoder):
    for text in ("a" * 20_000, " " * 20_000, "▁" * 999 + "x", "ab" * 10_000, "é" * 9_999, "日" * 5_000, "\n" * 5_000):
        assert encoder.encode(text) == " ".join(map(str, library.encode(text, add_eos=True)))


def test_forgetting_changes_nothing(library, monkeypatch):
    for chunks, pairs in ((3, 3), (2000, 500), (20_000, 3000)):
        monkeypatch.setattr(pieces, "CHUNK_BYTES", chunks)
        monkeypatch.setattr(pieces, "PAIR_BYTES", pairs)
        encoder = pieces.Encoder(pieces.Pieces(piece_model()))
        text = "the quick, brown fox. jumps over the lazy dog! again, the fox" * 5
        for some in (text, text, " ".join(f"w{k}o{k * k}" for k in range(400)) + text):
            assert encoder.encode(some) == " ".join(map(str, library.encode(some, add_eos=True)))
        assert encoder.later.bytes <= chunks and encoder.later.compatible.bytes <= pairs


def test_other_rules_are_refused(library, monkeypatch):
    plain = pieces.Encoder.encode
    monkeypatch.setattr(pieces.Encoder, "encode", lambda self, text: plain(self, text.strip()))
    pieces.pieces_of.cache_clear()
    with pytest.raises(ValueError, match="isn't supported"):
        pieces.pieces_of(piece_model())
    pieces.pieces_of.cache_clear()


def test_tables(spark, library):
    texts = {1: "Hello world.\nNew  line", 2: None, 3: "", 4: "née 日本 𝒳", 5: "long " * 60_000}
    rows = [(i, t, "x", 1) for i, t in texts.items()] + [(3, "", "x", 1), (None, "z", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    got = pieces.encode(df, piece_model()).collect()
    assert len(got) == len(rows)
    for x in got:
        text = "z" if x["doc_id"] is None else texts[x["doc_id"]] or ""
        assert x["ids"] == library.encode(text, add_eos=True) and x["decoded"] == library.decode(x["ids"])
    digest = {x["doc_id"]: x for x in pieces.digests(df, piece_model()).collect()}
    ids = library.encode(texts[4], add_eos=True)
    assert (digest[4]["n_tokens"], digest[4]["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert digest[4]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.digests(df.limit(0), piece_model()).collect() == []


def test_many_chunks_at_once(library, encoder):
    r = random.Random(4)
    signs = "abcdeéßñzxthering日本ΩПр,.'1𝒳"
    chunks = ["▁" + "".join(r.choice(signs) for _ in range(r.choice((1, 5, 12, 40, pieces.LEVELS - 1, pieces.LEVELS, 900)))) for _ in range(3000)]
    ids, texts = encoder.tables.ids(["", *chunks])
    assert ids[0] is None
    for chunk, found, text in zip(chunks, ids[1:], texts[1:], strict=True):
        want = library.encode(chunk[1:])  # it puts the mark first
        unknown = any(c not in encoder.pieces.known for c in chunk)
        assert (found is None) == (unknown or len(chunk) > pieces.LEVELS)
        if found is not None:
            assert found == " ".join(map(str, want)) and text == chunk.replace("▁", " ")
    assert encoder.tables.ids([]) == ([], [])
