import random
import re

import numpy as np

from flowsieve.llm import vectors as V

BREAK = r"[\x20\x09-\x0d]+"


def test_words_get_equal_digests_only_if_equal():
    rng = random.Random(5)
    text = "".join(rng.choice(["a", "b", "é", "漢", " ", "\n", "\x0b", "ab ", "\xa0"]) for _ in range(4000))
    words = [w for w in re.split(BREAK, text) if w]
    found = V.word_hashes(text)
    assert len(found) == len(words)
    pairs = set(zip(words, found.tolist()))
    assert len(pairs) == len(set(words)) == len(set(found.tolist()))


def test_digests_do_not_depend_on_where_chunks_end(monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcd") for _ in range(rng.choice([1, 3, 9, 40, 63, 64]))) for _ in range(300)]
    whole = V.word_hashes(" ".join(words))
    monkeypatch.setattr(V, "CHUNK", 64)
    monkeypatch.setattr(V, "_TABLES", [])
    assert V.word_hashes(" ".join(words)).tolist() == whole.tolist()
    long = "z" * 1000
    alone = V.word_hashes(long)[0]
    for before in ("", "a ", "a" * 63 + " ", "b " * 40):
        assert V.word_hashes(before + long + " c")[len(before.split())] == alone


def test_shingles_of_short_and_empty_texts():
    assert len(V.shingles(V.word_hashes(""))) == 0
    assert len(V.shingles(V.word_hashes("a b"))) == 1
    assert V.shingles(V.word_hashes("a b")).tolist() != V.shingles(V.word_hashes("b a")).tolist()
    five = V.shingles(V.word_hashes("a b c d e a b c d e"))
    assert len(five) == 5 and (np.diff(five.astype(object)) > 0).all()
