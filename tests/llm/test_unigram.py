import pyarrow as pa
import pytest

from ledgercheck.llm import unigram as U
from ledgercheck.llm.queries import VOCABULARY


@pytest.fixture(scope="module")
def pieces():
    return U.read_pieces(VOCABULARY)


def brute(pieces, pre_token):
    text, low, best = b" " + pre_token, min(pieces.values()) - U.PENALTY, [(0, 0)]
    longest = max(map(len, pieces))
    for i in range(1, len(text) + 1):
        options = [(best[i - 1][0] + low, best[i - 1][1] - 1)]
        for n in range(1, min(i, longest) + 1):
            score = pieces.get(text[i - n:i])
            if score is not None:
                options.append((best[i - n][0] + score, best[i - n][1] - 1))
        best.append(max(options))
    return -best[-1][1]


def test_equals_the_plain_recursion(make_docs, awkward, random_texts, pieces):
    rows = [r for r in awkward if len(r[1] or "") < 300_000] + [
        (100 + i, t) for i, t in enumerate(random_texts(9, 30))] + [
        (200, "Tokenisation internationalization of der Schönheit été, naïveté!? " * 20)]
    got = U.count_tokens(make_docs(rows), VOCABULARY).collect()
    expected = []
    for doc, text in rows:
        parts = (text or "").encode().split()
        counts = {p: brute(pieces, p) for p in set(parts)}
        expected.append((doc, len(parts), sum(counts[p] for p in parts)))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("block", [100, 1 << 16])
def test_long_pre_tokens_equal_the_plain_recursion(pieces, monkeypatch, block):
    """Texts without spaces of 10 kB and more; blocks shorter and longer than these."""
    import random

    import numpy as np

    monkeypatch.setattr(U, "BLOCK", block)
    rng, v = random.Random(block), U.Vocabulary(pieces)
    known = [p.strip() for p in list(pieces)[:4000] if p.strip()]
    for text in (b"ab" * 5000, "é日本\x00".encode() * 1500, b"x" * 12_000,
                 b"".join(rng.choice(known) for _ in range(3000)),
                 bytes(rng.randrange(33, 256) for _ in range(10_000))):
        assert U.count_long(np.frombuffer(b" " + text, np.uint8), v) == brute(pieces, text)


def test_long_and_short_ones_together(make_docs, pieces):
    long = "Donaudampfschiff" * 200
    rows = [(1, f"a {long} b"), (2, long[:1022]), (3, long[:1023]), (4, long[:1024]),
            (5, "x" * 300_000)]
    got = {r["doc_id"]: r["n_tokens"] for r in U.count_tokens(make_docs(rows), VOCABULARY).collect()}
    for doc, text in rows[:4]:
        assert got[doc] == sum(brute(pieces, p) for p in text.encode().split())
    assert 0 < got[5] < 300_000


def test_a_full_memory(pieces, monkeypatch):
    words = [f"w{i}x{i * 7}".encode() for i in range(500)]
    monkeypatch.setattr(U, "KNOWN_WORDS", 120)
    counter = U.Counter(U.Vocabulary(pieces))
    for lo in range(0, 500, 50):
        from ledgercheck.llm.common import string_buffers
        from ledgercheck.llm.tokens import NOT_SPACE, words as cut
        text = b" ".join(words[max(0, lo - 80):lo + 50]).decode()
        data, offsets = string_buffers(pa.array([text]))
        w = cut(data, offsets, NOT_SPACE, False, counter.hasher)
        assert counter.counts_of(w.hashes, w.data, w.starts, w.ends).tolist() == [
            brute(pieces, p) for p in text.encode().split()]


def test_empty_table(make_docs):
    assert U.count_tokens(make_docs([]), VOCABULARY).count() == 0
