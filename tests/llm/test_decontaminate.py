import hashlib
import re

from ledgercheck.llm.decontaminate import decontaminate, remove_hits

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items, size=10):
    runs = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            runs.setdefault(tuple(w[i:i + size]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = split(text), set(), set()
        for run, own in runs.items():
            for i in range(len(w) - len(run) + 1):
                if tuple(w[i:i + len(run)]) == run:
                    hit.update(range(i, i + len(run)))
                    found |= own
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(names),
                    hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def result(docs, benchmark, **more):
    return sorted(map(tuple, decontaminate(docs, benchmark, **more).select(
        "row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()),
        key=repr)


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items],
                                 "item_id long, text string, hash string")


def test_equals_brute_force(spark, make_docs, awkward, random_texts):
    items = [*enumerate(random_texts(3, 12, 30, 4)), (3, "one two"), (None, "three four five six"),
             (50, None), (51, ""), (52, "É-日本"), (53, "née Über")]
    rows = awkward + [(100 + i, t) for i, t in enumerate(random_texts(4, 40, 60, 4))]
    expected = brute(rows, items)
    assert any(r[-1] for r in expected) and not all(r[-1] for r in expected)
    docs, benchmark = make_docs(rows), items_frame(spark, items)
    assert result(docs, benchmark) == expected
    # a benchmark of many blocks gives the same rows
    assert result(docs, benchmark, max_windows=40) == expected


def test_empty_tables(spark, make_docs):
    benchmark = items_frame(spark, [(1, "a b")])
    assert result(make_docs([]), benchmark) == []
    assert result(make_docs([(1, "a b")]), benchmark.where("false")) == brute([(1, "a b")], [])


def test_removal_cuts_passages_and_keeps_the_rest(spark, make_docs):
    passage = " ".join(f"q{i}" for i in range(12))
    rest = " ".join(f"r{i}" for i in range(30))
    docs = make_docs([(1, rest), (2, f"{rest}. {passage.upper()}! End é."), (3, passage), (4, None),
                      (5, "")])
    left = remove_hits(docs, items_frame(spark, [(1, passage)]))
    assert left.columns == docs.columns
    got = {r["doc_id"]: r for r in left.collect()}
    assert set(got) == {1, 2, 4, 5}
    assert got[2]["text"] == f"{rest}. ! End é." and got[2]["n_chars"] == len(got[2]["text"])
    assert got[1]["text"] == rest and got[2]["score"] == "score-1" and got[4]["text"] is None
