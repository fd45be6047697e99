import re

import numpy as np
import pyarrow as pa

from ledgercheck.llm.common import string_buffers
from ledgercheck.llm.fmindex import FMIndex
from ledgercheck.llm.tokens import ALNUM, NOT_SPACE, Hasher, windows, words

TEXTS = ["Ab1 c-d", None, "", "  ", "é日本x\u00a0y", "a\x0bb\x1fc", "Z", "tail "]


def test_words_are_those_of_the_patterns():
    data, offsets = string_buffers(pa.array(TEXTS))
    for allowed, lower, pattern in (
            (ALNUM, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
            (NOT_SPACE, False, r"[^\x20\x09-\x0D]+")):
        w = words(data, offsets, allowed, lower, Hasher())
        got = [[w.text(i).decode() for i in range(a, b)] for a, b in zip(w.first, w.first[1:])]
        table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        assert got == [re.findall(pattern, (t or "").translate(table) if lower else t or "")
                       for t in TEXTS]


def test_hashes_follow_the_words_alone(random_texts):
    texts = random_texts(1, 50)
    data, offsets = string_buffers(pa.array(texts))
    w = words(data, offsets, NOT_SPACE, False, Hasher())
    at, codes = windows(w, 5, Hasher())
    by_hash = {}
    for i, code in zip(at.tolist(), codes.tolist()):
        assert by_hash.setdefault(code, w.joined(i, 5)) == w.joined(i, 5)
    assert len(set(by_hash.values())) == len(by_hash)
    assert len(at) == sum(max(0, len(t.split()) - 4) for t in texts)


def test_matching_statistics_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(30):
        depth, n_symbols = int(rng.integers(3, 21)), int(rng.integers(2, 9))
        parts = [rng.integers(1, n_symbols, int(rng.integers(depth, depth + 12)))
                 for _ in range(int(rng.integers(1, 40)))]
        text = np.concatenate([np.append(p, 0) for p in parts])
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        starts = ends - np.array([len(p) for p in parts])
        order = rng.permutation(len(text))
        _, at, least = FMIndex(text, order, n_symbols, depth).statistics(text, starts, ends)
        first = {}
        for a, b in zip(starts, ends):
            for i in range(a, b - depth + 1):
                run = tuple(text[i:i + depth])
                first[run] = min(first.get(run, len(text)), order[i])
        assert len(at) == sum(len(p) - depth + 1 for p in parts)
        assert all(first[tuple(text[i:i + depth])] == k for i, k in zip(at, least))
