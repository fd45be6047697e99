import hashlib
import itertools
import random
import re

import pytest

from ledgercheck.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, audit string, kind int, h string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 9, "y") for r in rows], SCHEMA)


def told(rows):
    """Faults of rows in order: (role, text, fault)."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        fault = ("blank" if not bare else "duplicate" if (role, text) in seen
                 else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute(rows):
    """Cheapest edits by trying the prefixes of all of them, the least audit of those."""
    ways = {"": (0, "", ())}   # final initials: cost, audit, lines

    def insert(ways):
        found = dict(ways)
        for _ in range(3):
            for done, (cost, audit, lines) in list(found.items()):
                for role in ("user", "assistant"):
                    better(found, done + role[0], (cost + 5, audit + "I", (*lines, role + ":")))
        return found

    def better(into, key, way):
        if re.fullmatch(r"s?(ua)*u?", key) and (key not in into or way[:2] < into[key][:2]):
            into[key] = way

    for role, text, fault in told(rows):
        after = {}
        for done, (cost, audit, lines) in insert(ways).items():
            better(after, done, (cost + 2, audit + "D", lines))
            if fault in ("", "truncated"):
                stay = 5 if fault else 0
                better(after, done + role[:1] if role[:1] in ("s", "u", "a") else "-",
                       (cost + stay, audit + "K", (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    better(after, done + new[0],
                           (cost + 1 + stay, audit + "R", (*lines, f"{new}:{text}")))
        ways = after
    ends = [w for done, w in insert(ways).items() if re.fullmatch(r"(s?(ua)+)?", done)]
    return min(ends, key=lambda w: w[:2])


def expected(rows):
    faults = [f for _, _, f in told(rows)]
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(rows)]
    cost, audit, lines = brute(rows)
    return (*[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)


def random_rows(rng, n):
    roles = rng.choice([("user", "assistant"), ("user", "assistant", "system", "tool", "")])
    texts = ("Yes.", "No!", "cut off", " \n", "", "And more?", "x. ")
    return [(rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"t{i}.")
            for i in range(n)]


def test_equals_brute_force(spark):
    rng = random.Random(3)
    convs = {k: random_rows(rng, rng.randrange(1, 9)) for k in range(150)}
    rows = [(k, i, *r) for k, own in convs.items() for i, r in enumerate(own)]
    rng.shuffle(rows)
    edits, lines = c.repair(frame(spark, rows))
    sums = c.digests(c.marked(frame(spark, rows)), edits).collect()
    kept = {}
    for r in sorted(lines.collect(), key=lambda r: r["place"]):
        kept.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert len(sums) == len(convs)
    for r in sums:
        want = expected(convs[r["conv_id"]])
        assert (r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"],
                r["repaired_sha256"]) == want[:7]
        assert tuple(kept.get(r["conv_id"], ())) == want[7]


def test_runs_of_any_length_equal_single_steps():
    rng = random.Random(5)
    for _ in range(40):
        symbols = [rng.randrange(16) for _ in range(rng.randrange(1, 6))]
        lengths = [rng.choice((1, 2, 3, 7, 64, 100)) for _ in symbols]
        single = [s for s, n in zip(symbols, lengths) for _ in range(n)]
        assert c.Solver().solve(symbols, lengths) == c.Solver().solve(single, [1] * len(single))
    cost, audit = c.Solver().solve([4], [100_000])   # one speaker: every second row changes role
    assert (cost, audit) == (50_000, "KR" * 50_000)


def test_hot_conversation_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(c, "RUNS_PER_ROW", 16)
    rng = random.Random(11)
    hot = random_rows(rng, 300) + [("user", "same.")] * 500
    rows = [(None, None if i < 10 else i, *r) for i, r in enumerate(hot)]
    first = sorted(rows[:10], key=lambda r: (r[2], r[3]))
    order = [(r[2], r[3]) for r in first + rows[10:]]
    small = [(k, t, "user", f"q{k}.") for k in range(50) for t in range(2)]
    data = frame(spark, rows + small).repartition(8)
    edits = c.audits(c.marked(data)).collect()
    got = next(r for r in edits if r["conv_id"] is None)
    solver = c.Solver()
    faults = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
    roles = {"s": 0, "u": 1, "a": 2}
    symbols = [roles.get(r[:1], 3) * 4 + faults[f] for r, _, f in told(order)]
    assert (got["cost"], got["audit"]) == solver.solve(symbols, [1] * len(symbols))
    assert len(edits) == 51 and got["duplicate"] >= 499


def test_gaps_and_dropped_conversations(spark):
    rows = [(k, t, "user", "a.") for k in range(300) for t in (0, 3)]
    data = frame(spark, rows)
    got = {r["conv_id"]: r for r in c.digests(
        c.damaged(data), c.audits(c.damaged(data))).collect()}
    import zlib
    for k in range(300):
        left = [t for t in (0, 3) if zlib.crc32(f"{k}:{t}".encode()) % 20]
        assert got[k]["gaps"] == (2 if len(left) == 2 else 0)
        if not left:
            assert got[k]["audit"] == "" and got[k]["cost"] == 0
            assert got[k]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("rows", [
    [], [(None, None, None, None)], [(1, 0, "user", "x" * 300_000 + ".")] * 3,
    [(1, None, "user", ""), (1, None, None, "né\x00日本."), (None, 2, "assistant", None)]])
def test_awkward_rows(spark, rows):
    edits, lines = c.repair(frame(spark, rows))
    assert edits.count() == len({r[0] for r in rows})
    sums = c.digests(c.damaged(frame(spark, rows)), c.audits(c.damaged(frame(spark, rows))))
    assert sums.count() == len({r[0] for r in rows})
    assert all(r["role"][0] in "sua" for r in lines.collect())
