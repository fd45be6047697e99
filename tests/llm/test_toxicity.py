import random

import numpy as np

from ledgercheck.llm import toxicity as T


def corpus(n, seed=3):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        toxic = int(i % 5 == 0)
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "rotten", "nastiest"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    return rows, labels


def frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows(spark, make_docs):
    rows, labels = corpus(800)
    docs = make_docs(rows)
    model = T.learn(docs, docs.where("doc_id < 500"), frame(spark, labels))
    got = {r["row"]["doc_id"]: r["score"] for r in T.score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in labels if i >= 500]
    assert all(0 <= s <= 1 for s in got.values())
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.97


def test_nearest_are_those_of_brute_force():
    rng = np.random.default_rng(1)
    entries = []
    for _ in range(700):
        t = np.sort(rng.choice(50, rng.integers(1, 8), replace=False))
        w = rng.random(len(t)) + 0.1
        entries.append((t, w / np.sqrt((w ** 2).sum())))
    index = T.BlockMax(entries, np.ones((700, 2)), 50)
    dense = np.zeros((700, 50))
    for i, (t, w) in enumerate(entries):
        dense[i, t] = w
    for i in range(0, 700, 7):
        t, w = entries[i]
        at, score = index.nearest(t, w, 15, without=i)
        true = dense @ dense[i]
        true[i] = -1
        order = np.lexsort((np.arange(700), -np.round(true, 12)))[:15]
        order = order[true[order] > 0]
        assert np.allclose(score, true[order]) and len(at) == len(order)


def test_awkward_rows_and_few_labels(spark, make_docs, awkward):
    rows, labels = corpus(300)
    docs = make_docs(rows + [(None if d is None else d + 1000, t) for d, t in awkward])
    for own in ([], [(0, 1, 1)], [(None, 1, 1), (1, None, None), (0, 1, 1), (0, 1, 0), (1, 0, 0)],
                labels):
        model = T.learn(docs, docs, frame(spark, own))
        got = T.score(docs, model).collect()
        assert len(got) == 300 + len(awkward) and all(0 <= r["score"] <= 1 for r in got)
    assert T.score(make_docs([]), model).count() == 0
