import random

import public_tokenizers
import pytest
import sentencepiece

from flowsieve.llm import tokens as T

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.mark.parametrize("chunk, overlap", [(40, 4), (64, 8), (200, 16)])
def test_splicing_is_exact(model, chunk, overlap):
    rng = random.Random(chunk)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    counter = T.Counter(model, chunk, overlap)
    signs = ["a", "b", " ", "  ", "\n", "é", "▁", "😀", "\x00", "漢", "the ", "ing", " x", "́", "▁▁", "<s>"]
    for k in range(600):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(0, 600)))
        if k % 5 == 0:  # no boundary at all: the overlap must widen to the whole text
            text = text.replace(" ", "").replace("▁", "")
        assert counter.count(text) == len(library.encode(text))


def test_a_model_without_proven_boundaries_is_refused(model, monkeypatch):
    class Spanning:
        def __init__(self, model_proto):
            self.pieces = ["a", "a▁b"]

        def get_piece_size(self):
            return len(self.pieces)

        def id_to_piece(self, k):
            return self.pieces[k]

        is_byte = is_control = is_unknown = lambda self, k: False

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Spanning)
    with pytest.raises(ValueError):
        T.Counter(model)


def test_edge_and_real_rows(model, edge, nothing, tables):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    for df in (edge, tables("documents")):
        expected = []
        for r in df.select("doc_id", "text").collect():
            n, t = len(library.encode(r["text"] or "")), r["text"] or ""
            expected.append((str(r["doc_id"]), len(t.encode()), n, n > 4096))
        found = T.count_tokens(df, PATH).collect()
        assert sorted((str(r[0]), *r[1:]) for r in found) == sorted(expected)
    assert T.count_tokens(nothing, PATH).count() == 0
