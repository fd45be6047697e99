import hashlib
import random

import pytest

from ledgercheck.llm.repeats import remove_repeats


def brute(rows, size=20):
    places = {}
    split = [(r[0], (r[1] or "").encode().split()) for r in rows]
    for doc, w in split:
        order = (doc is not None, doc or 0)
        for i in range(len(w) - size + 1):
            run = tuple(w[i:i + size])
            places[run] = min(places.get(run, (True, 1 << 62, 0)), (*order, i))
    out = []
    for doc, w in split:
        order, gone = (doc is not None, doc or 0), set()
        for i in range(len(w) - size + 1):
            if places[tuple(w[i:i + size])] < (*order, i):
                gone.update(range(i, i + size))
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def result(docs, **more):
    return sorted(map(tuple, remove_repeats(docs, **more).drop("kept").collect()), key=repr)


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(120)]
    rows = []
    for i in range(60):
        own = [word() for _ in range(rng.randrange(80))]
        if i % 3 == 0:
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage[rng.randrange(20):40 + rng.randrange(20)]
        if i % 4 == 1:  # near copies
            own = [word() if rng.random() < 0.02 else w for w in base]
        rows.append((i, " ".join(own)))
    rows += [(70, " ".join(base)), (71, " ".join(base)), (71, " ".join(base)),
             (71, "other " + " ".join(base)), (None, " ".join(passage)),
             (72, " ".join(["a"] * 100)), (73, " ".join(passage * 3))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("max_segments", [4096, 3])
def test_equals_brute_force(make_docs, awkward, max_segments):
    rows = corpus() + [(None if d is None else d + 1000, t) for d, t in awkward]
    expected = brute(rows)
    assert sum(r[2] > 0 for r in expected) > 20
    assert result(make_docs(rows), max_segments=max_segments) == expected


def test_empty_and_short(make_docs):
    assert result(make_docs([])) == []
    rows = [(1, "a b"), (2, "a b"), (3, None)]
    assert result(make_docs(rows)) == brute(rows)
