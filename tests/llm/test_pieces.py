import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from threatspark.llm import pieces
from threatspark.llm.pieces import PieceEncoder, encode_and_decode

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return PieceEncoder(f.read())


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ENCODER = PieceEncoder(open(PATH, "rb").read())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  ▁\n\tetaoinshr.,é")), max_size=60))
def test_any_text(text):
    assert ENCODER.encode(text).tolist() == LIBRARY.encode(text)


def test_runs_of_blanks_and_signs(encoder):
    for c in " =-a\n":
        for n in range(120):
            for tail in ("", "x", " the"):
                assert encoder.encode(c * n + tail).tolist() == LIBRARY.encode(c * n + tail)


def test_texts_made_of_pieces(encoder):
    rng = random.Random(5)
    known = list(encoder.score)
    for _ in range(2000):
        text = "".join(rng.choice(known) for _ in range(rng.randint(1, 9))).replace("▁", " ")
        assert encoder.encode(text).tolist() == LIBRARY.encode(text)


def test_compatibility_is_what_merging_again_gives(encoder):
    rng = random.Random(6)
    known = [t for t in encoder.score if len(t) < 8]
    for _ in range(20000):
        a, b = rng.choice(known), rng.choice(known)
        assert encoder.compatible(encoder.number[a], encoder.number[b]) == (encoder.merged(a + b) == [a, b])


def test_without_runs_and_with_a_small_cache(encoder, monkeypatch):
    text = "The quick brown fox, das süße Kätzchen  und\n\nl'été " * 5
    monkeypatch.setattr(pieces, "CACHED_RUNS", 4)
    assert encoder.encode(text).tolist() == LIBRARY.encode(text)
    monkeypatch.setattr(encoder, "runs", None)
    assert encoder.encode(text).tolist() == LIBRARY.encode(text)


def test_documents(awkward, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE_CHARS", 10)
    got = encode_and_decode(awkward, PATH, keep=["ids", "kept"]).toDF("doc_id", "pieces", "decoded", "ids", "kept").collect()
    expected = [(r.doc_id, LIBRARY.encode(r.text or "")) for r in awkward.collect()]
    assert sorted(((r.doc_id, list(r.pieces)) for r in got), key=str) == sorted(expected, key=str)
    assert all(r.decoded == LIBRARY.decode(list(r.pieces)) and (r.ids, r.kept) == ("z", "x") for r in got)


def test_empty_table(make_docs):
    assert encode_and_decode(make_docs([(1, "a")]).limit(0), PATH).count() == 0
