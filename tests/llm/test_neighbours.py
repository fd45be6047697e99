import numpy as np
from pyspark.sql import functions as F

from ledgercheck.llm.neighbours import search, walk


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows],
                                 "vec_id long, embedding array<float>, cell string, score double")


def found(spark, rows, **more):
    out = {}
    for r in search(frame(spark, rows), F.col("vec_id") % 20 == 0, **more).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [x[1:] for x in sorted(own)] for q, own in out.items()}


def brute(rows, top=20):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if v and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 8]
    return {q: sorted(((i, float(x @ v)) for i, v in good if i != q), key=lambda r: (-r[1], r[0]))
            [:top] for q, x in good if q % 20 == 0}


def test_recall_scores_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1500)]
    rows += [(i, [1.0] + [0.0] * 7) for i in range(2000, 2400)]  # a third are one vector
    bad = [(3000, None), (3020, []), (3040, [0.0] * 8), (3060, [None] + [1.0] * 7),
           (3080, [float("nan")] * 8), (3100, [float("inf")] * 8), (3120, [1.0, 2.0])]
    got, true = found(spark, rows + bad), brute(rows + bad)
    assert set(got) == set(true)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in true[q]}) for q in true)
    assert hit >= 0.9 * sum(map(len, true.values()))
    exact = dict(rows)
    for q, own in got.items():
        assert len(own) == 20 and own == sorted(own, key=lambda r: (-r[1], r[0]))
        for i, score in own:
            value = np.float32(exact[q]).astype(float) @ np.float32(exact[i]).astype(float)
            assert abs(score - value) < 1e-12
    # equal vectors: the smaller ids
    assert [i for i, s in got[2000] if s == 1.0] == [i for i, s in true[2000] if s == 1.0]


def test_few_rows_and_empty_table(spark):
    assert found(spark, []) == {}
    assert found(spark, [(20, [1.0] * 8)]) == {}
    rows = [(20, [1.0] * 8), (21, [2.0] * 8), (22, [2.0] * 8), (22, [2.0] * 8)]
    assert found(spark, rows) == {20: [(21, 16.0), (22, 16.0), (22, 16.0)]}


def test_walk_takes_pairs_by_summed_distance():
    rng = np.random.default_rng(2)
    a, b, sizes = rng.random(7), rng.random(7), rng.integers(0, 5, 49)
    order = list(walk(a, b, sizes, float("inf")))
    total = [a[c // 7] + b[c % 7] for c in order]
    assert sorted(order) == list(range(49)) and total == sorted(total)
    some = list(walk(a, b, sizes, 20))
    assert sizes[some].sum() >= 20 > sizes[some[:-1]].sum()


def test_null_ids_take_no_part(spark):
    rng = np.random.default_rng(9)
    rows = [(i if i % 3 else None, rng.normal(size=8).tolist()) for i in range(300)]
    got = found(spark, rows)
    assert set(got) == {i for i, _ in rows if i is not None and i % 20 == 0}
    assert all(i is not None for own in got.values() for i, _ in own)


def test_small_tables_are_passed_whole(spark):
    """All candidates where there are no more than asked for, whatever the calibration says."""
    for seed, n in ((1, 12), (2, 20), (3, 21)):
        rng = np.random.default_rng(seed)
        rows = [(20 * i, rng.normal(size=8).tolist()) for i in range(n)]
        got, true = found(spark, rows), brute(rows)
        assert {q: [i for i, _ in own] for q, own in got.items()} == {
            q: [i for i, _ in own] for q, own in true.items()}
