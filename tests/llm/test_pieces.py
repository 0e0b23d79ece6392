"""SentencePiece encoding and decoding against the library."""

import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from curalake.llm import sentence_pieces  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Odd texts: marks, runs of spaces, bytes that have no piece, characters that separate chunks in a block.
ANY = st.one_of(st.text(max_size=40), st.text(alphabet="aab tThe\u2581  .\n\té日<s>\x000x\ufdd0\ufdd1", max_size=40))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def digests(library, text):
    ids = library.encode(text or "", add_eos=True)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


@given(st.lists(ANY, max_size=4))
@settings(max_examples=500, deadline=None)
def test_chunks_are_the_library(library, texts):
    own = sentence_pieces.chunk_table(PIECES)
    for text in texts:
        ids = library.encode(text)
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids)


@pytest.mark.parametrize(("block", "rows"), [(1 << 22, 400_000), (20, 400_000), (20, 3)])
def test_blocks_and_turns(library, monkeypatch, block, rows):
    """Results don't depend on where a text is cut into blocks, nor on how much the table keeps."""
    monkeypatch.setattr(sentence_pieces, "BLOCK", block)
    monkeypatch.setattr(sentence_pieces.ChunkTable, "ROWS", rows)
    own = sentence_pieces.DigestTable(PIECES)

    @given(st.lists(ANY, max_size=4))
    @settings(max_examples=200, deadline=None)
    def check(texts):
        assert own.digests(texts, 2) == [digests(library, t) for t in texts]

    check()
    every = "".join(map(chr, range(0xFDD0, 0xFDF0)))
    texts = [f"a  b {every} c", "", " ", "x" * 3000 + " y" * 500]
    assert own.digests(texts, 2) == [digests(library, t) for t in texts]


def test_query(spark, docs, none, rows, library):
    got = sorted(map(tuple, sentence_pieces.round_trip_digests(docs, PIECES).collect()), key=str)
    assert got == sorted(((i, *digests(library, t)) for i, t, _ in rows), key=str)
    assert sentence_pieces.round_trip_digests(none, PIECES).count() == 0
    back = sentence_pieces.decode(sentence_pieces.encode(docs, PIECES), PIECES)
    assert [c for c in back.columns if c not in docs.columns] == ["ids", "decoded"]
    assert all(r.decoded == (r.text or "") and r.ids[-1] == 2 for r in back.collect())
