from collections import Counter

import pytest

from ledgercheck.llm import mixing


def rows(counts):
    n, out = 0, []
    for source, count in counts.items():
        for _ in range(count):
            out.append((n, "t", "en", source))
            n += 1
    return out


def blocks_in_order(docs, **more):
    got = mixing.mix(docs, **more).select("row.doc_id", "row.source", "share", "period", "block",
                                          "slot", "position", "in_mix").collect()
    slots = {}
    for r in got:
        slots.setdefault(r["slot"], (r["source"], r["block"], r["share"], r["period"], r["in_mix"]))
        assert slots[r["slot"]][:2] == (r["source"], r["block"])  # one block per slot
    return got, slots


def check_bound(slots):
    placed, period = Counter(), None
    shares = {s: share for s, _, share, _, _ in slots.values()}
    for slot in sorted(slots):
        source, block, share, period, in_mix = slots[slot]
        if not in_mix:
            return slot
        assert slot == sum(placed.values())  # no empty slot before a source runs out
        placed[source] += 1
        for s, a in shares.items():
            assert abs(placed[s] - (slot + 1) * a / period) < 1
    return None


@pytest.mark.parametrize("counts", [
    {"a": 3000, "b": 700, None: 90, "": 40, "c": 1}, {"a": 500}, {"a": 65, "b": 64, "c": 63},
    {chr(97 + i): 20 + 13 * i * i for i in range(20)}])
def test_less_than_a_block_from_target(make_docs, counts):
    docs = make_docs(rows(counts))
    got, slots = blocks_in_order(docs, block_rows=8)
    assert len(got) == sum(counts.values()) == len({r["position"] for r in got})
    for source, n in counts.items():
        own = sorted(r["block"] for r in got if r["source"] == source)
        assert own == [i // 8 for i in range(n)]
    check_bound(slots)


def test_given_weights(spark, make_docs):
    weights = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "source string, weight double")
    got, slots = blocks_in_order(make_docs(rows({"a": 900, "b": 300})), weights=weights,
                                 block_rows=1)
    check_bound(slots)
    first = [slots[i][0] for i in range(400)]
    assert Counter(first) == {"a": 300, "b": 100}


def exact_bound(got, slots, weights, block_rows=1):
    """At every slot of the mix no source is a block from weight / sum of weights."""
    from fractions import Fraction

    total = sum(Fraction(w) for w in weights.values())
    placed, order, length = Counter(), sorted(slots), 0
    for n, slot in enumerate(order):
        if not slots[slot][4]:
            break
        assert slot == n
        placed[slots[slot][0]] += 1
        for s, w in weights.items():
            assert abs(placed[s] - (n + 1) * Fraction(w) / total) < 1
        length = n + 1
    return length


@pytest.mark.parametrize("given", [
    {"a": "0.1234", "b": "0.8766", "c": "0"}, {"a": "0.0004", "b": "0.9996"},
    {"a": "3", "b": "7", "c": "1"}, {"a": "0.333333333", "b": "0.666666667", "c": "0.000000001"},
    {"a": "100000", "b": "300000"}])
def test_given_weights_are_exact(spark, make_docs, given):
    counts = {"a": 500, "b": 1700, "c": 40}
    weights = spark.createDataFrame([(s, float(w)) for s, w in given.items()],
                                    "source string, weight double")
    got, slots = blocks_in_order(make_docs(rows(counts)), weights=weights, block_rows=1)
    assert len(got) == sum(counts.values()) == len({r["position"] for r in got})
    weight = {s: given.get(s, "0") for s in counts}
    length = exact_bound(got, slots, weight)
    # the mix goes on until a source with a weight runs out
    total = sum(map(float, weight.values()))
    ends = [n * total / float(weight[s]) for s, n in counts.items() if float(weight[s])]
    assert min([*ends, sum(counts.values())]) - 2 <= length + max(1, total / min(
        float(w) for w in weight.values() if float(w)))
    last = [r["source"] for r in sorted(got, key=lambda r: r["position"])]
    without = {s for s, w in weight.items() if not float(w)}
    if without:
        n = sum(counts[s] for s in without)
        assert set(last[-n:]) == without and not set(last[:-n]) & without


def test_weights_of_other_sources_nulls_and_none(spark, make_docs):
    docs = make_docs(rows({"a": 30, None: 10, "x": 5}))
    weights = spark.createDataFrame(
        [("a", 0.5), ("a", 0.25), (None, 0.25), ("gone", 3.0), ("x", None), ("x", float("nan")),
         ("x", -1.0)], "source string, weight double")
    got, slots = blocks_in_order(docs, weights=weights, block_rows=1)
    first = [slots[i][0] for i in range(40)]
    assert Counter(first) == {"a": 30, None: 10}
    assert exact_bound(got, slots, {"a": "0.75", None: "0.25"}) == 40
    nothing = weights.limit(0)
    got, slots = blocks_in_order(docs, weights=nothing, block_rows=4)
    assert len(got) == 45 == len({r["position"] for r in got}) and not any(
        r["in_mix"] for r in got)
    assert mixing.mix(make_docs([]), weights).count() == 0


def test_any_number_of_sources(make_docs):
    counts = {f"s{i:04d}": 1 for i in range(1500)} | {"big": 300}
    got, slots = blocks_in_order(make_docs(rows(counts)), block_rows=1)
    assert len(got) == 1800 == len(slots) and {r["source"] for r in got} == set(counts)
    check_bound(slots)


def test_buckets_of_a_large_source(make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    got, slots = blocks_in_order(make_docs(rows({"a": 1000, "b": 10})), block_rows=4)
    assert sorted(r["block"] for r in got if r["source"] == "a") == [i // 4 for i in range(1000)]
    check_bound(slots)


def test_repeated_and_null_ids_and_empty(make_docs, awkward):
    got = mixing.mix(make_docs(awkward)).collect()
    assert len(got) == len(awkward) and got[0]["row"]["key"].startswith("key-")
    assert mixing.mix(make_docs([])).count() == 0
