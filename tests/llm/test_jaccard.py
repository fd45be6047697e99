import random
from math import comb

import pytest

from ledgercheck.llm import jaccard as J

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = (text or "").translate(LOWER).encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                comp[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        ids = least.setdefault(find(i), [])
        if r[0] is not None:
            ids.append(r[0])
    return sorted(((r[0], len(sets[i]), min(least[find(i)], default=None))
                   for i, r in enumerate(rows)), key=repr)


def result(docs):
    return sorted(map(tuple, J.similarity_join(docs).select(
        "doc_id", "n_shingles", "component_id").collect()), key=repr)


def near_copies(seed, groups, size, words, edits):
    rng, out = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(edits + 1)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10_000)}"
            out.append(" ".join(own))
    return out


def test_equals_brute_force(make_docs, awkward, random_texts):
    texts = near_copies(1, 6, 12, 60, 4) + near_copies(2, 12, 10, 9, 1) + random_texts(3, 60, 14, 2)
    texts += near_copies(4, 3, 40, 200, 12)
    rows = [(i + 100, t.upper() if i % 9 == 0 else t) for i, t in enumerate(texts)] + awkward
    expected = brute(rows)
    assert len({r[2] for r in expected}) < len(rows) - 60
    assert result(make_docs(rows)) == expected


def test_chains_across_a_list(make_docs):
    """Each text links with the next only; all share most of their shingles' order."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i:4 * i + 100])) for i in range(60)]
    assert result(make_docs(rows)) == brute(rows)


@pytest.mark.parametrize("boundary", [1, 4, 12])
def test_any_boundary_gives_the_same_links(make_docs, monkeypatch, boundary):
    rows = [(i, t) for i, t in enumerate(near_copies(5, 10, 6, 12, 1) + near_copies(6, 6, 6, 20, 1))]
    monkeypatch.setattr(J, "choose_boundary", lambda sizes: boundary)
    assert result(make_docs(rows)) == brute(rows)


def test_boundary_is_the_cheapest():
    assert J.choose_boundary({}) == 1
    assert 3 <= J.choose_boundary({n: 1000 for n in range(1, 25)}) <= 9
    assert comb(8, J.needed(7, 8)) == 8 and J.needed(8, 8) == 7
    assert J.look_ups(8) == 3 and J.entries(8) == 2


def test_one_of_each_group_stays(make_docs):
    texts = near_copies(7, 3, 5, 40, 1)
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (50, None), (51, ""), (52, "")]
    docs = make_docs(rows)
    out = J.keep_one(docs)
    assert out.columns == docs.columns
    kept = sorted(r["doc_id"] for r in out.collect())
    assert kept == sorted({c for _, n, c in brute(rows) if n} | {50, 51, 52})


def test_groups_with_one_id_or_none_all_stay(make_docs):
    a, b, c, d = near_copies(8, 4, 1, 40, 0)
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (6, c)]
    kept = sorted(((r["doc_id"], r["text"]) for r in J.keep_one(make_docs(rows)).collect()), key=repr)
    assert kept == sorted([(None, a), (None, b), (5, c), (5, d)], key=repr)


def test_empty_table(make_docs):
    assert result(make_docs([])) == []
    assert J.keep_one(make_docs([])).count() == 0


def test_postings_of_single_sets_pack_small():
    """Counts in place of places: what a bucket of sets with one posting each says is constant."""
    import zlib

    import numpy as np

    at = np.sort(np.random.default_rng(1).choice(1 << 20, 5000, replace=False))
    at = np.concatenate([at, at[-1:]])
    used, counts = J.runs_of(at)
    assert (np.repeat(used, counts) == at).all() and counts.dtype == np.uint32
    assert len(zlib.compress(counts.tobytes(), 1)) < len(at) // 4
