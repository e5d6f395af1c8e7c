import numpy as np
import pytest

from millrace.llm import common
from millrace.llm.common import WordHash, mix, ngram_hashes, raw_words_of, words_of


def test_words():
    assert words_of("Ab\tc\x0bD\x1cé  É\n") == [b"ab", b"c", "d\x1cé".encode(), "É".encode()]
    assert raw_words_of("Ab c") == [b"Ab", b"c"] and words_of(None) == words_of("") == []


def test_hashes():
    h = WordHash(limit=2)
    a = h.of([b"a", b"b", b"c", b"a"])
    assert a[0] == a[3] and len(set(a.tolist())) == 3 and len(h) <= 2
    x = np.arange(10, dtype=np.uint64)
    assert len(ngram_hashes(x, 4)) == 7 and len(ngram_hashes(x, 11)) == 0
    assert ngram_hashes(x, 3)[2] == ngram_hashes(x[2:5], 3)[0] and len(np.unique(mix(x))) == 10


@pytest.mark.parametrize("n", [1, 2, 5])
def test_ngrams_depend_on_order(n):
    x = np.arange(6, dtype=np.uint64)
    assert len(np.unique(np.concatenate([ngram_hashes(x, n), ngram_hashes(x[::-1].copy(), n)]))) == (6 if n == 1 else 2 * (7 - n))


def test_word_hashes(monkeypatch):
    """Equal words have equal hashes wherever they stand, others differ; pieces, long words, folding and all blanks."""
    texts = ["", None, "one two\tone\x0bTwo\x0cthree\r\n ", "\u00a0x \u3000 \x1cy", "w" * 40 + " " + "w" * 41 + " " + "W" * 40, *(" ".join(f"v{i * j % 97}" for i in range(300)) for j in range(5)), b"one"]
    words = [(t.encode() if isinstance(t, str) else t or b"").split() for t in texts]
    for piece in (1 << 20, 50):
        monkeypatch.setattr(common, "_PIECE", piece)
        for fold in (False, True):
            h, ends = common.word_hashes(texts, fold)
            assert np.diff(ends, prepend=0).tolist() == list(map(len, words))
            flat = [w.lower() if fold else w for ws in words for w in ws]
            assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))
    assert [len(x) for x in common.word_hashes([])] == [0, 0] and [len(x) for x in common.word_hashes([None, ""])] == [0, 2]
