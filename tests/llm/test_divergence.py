import re
from collections import Counter, defaultdict

import pytest

from ledgercheck.llm import divergence as d

LETTER = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top):
    counts, per_lang, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = LETTER.findall((text or "").translate(LOWER))
        counts[lang, source].update(words)
        per_lang[lang].update(words)
        docs[lang].update(set(words))
    out = []
    for (lang, source), own in counts.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)

        def p(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept))

        pairs = [(sum(abs(p(own, t) - p(other, t)) for t in kept), s)
                 for (la, s), other in counts.items() if la == lang and s != source]
        over = [(p(own, t) - p(per_lang[lang], t), t) for t in kept if own[t]]
        over = [x for x in over if x[0] > 0]
        for part, items, most in (("pair", pairs, None), ("term", over, top)):
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i + 1)
                    for i, (value, item) in enumerate(items[:most])]
    return sorted(out)


def some_rows(random_texts):
    texts = random_texts(4, 400, 60, 30)
    mixed = [t.replace("w1", "É1x").replace("w2", "Wß-日") for t in texts]
    langs, sources = ["en", "de", None, ""], ["a", "b", None, "", "c", "é"]
    return [(i, t, langs[i % 4 if i % 3 else 0], sources[i % 6 if i % 2 else 0])
            for i, t in enumerate(texts + mixed)] + [(1, None, "en", "empty"), (2, "", "xx", "a"),
                                                     (3, "only here", "xx", "b")]


def test_equals_brute_force(make_docs, random_texts, monkeypatch):
    monkeypatch.setattr(d, "BUCKET_TERMS", 3)
    monkeypatch.setattr(d, "TILE_SOURCES", 2)
    monkeypatch.setattr(d, "HELD", 20)
    rows = some_rows(random_texts)
    got = d.audit(make_docs(rows), min_docs=10, top_terms=7).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10, 7)


def test_division_is_exact_beyond_64_bit_products(spark):
    cases = [(9 * 10**13, 2 * 10**14, 10**6), (0, 0, 1), (10**12 + 7, 10**12 + 7, 1),
             (3, 10**14 + 1, 999_983)]
    df = spark.createDataFrame(cases, "n long, t long, v long")
    got = df.select(d.share(df.n, df.t, df.v)).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in cases]


def test_terms():
    text = "Née ÉCOLE's x1Y\x00Z q [A]_b @C`D{E\x7fF"
    assert [t.decode() for t in d.terms(text.encode())] == LETTER.findall(text.translate(LOWER))


@pytest.mark.parametrize("min_docs", [1, 30])
def test_awkward_rows(make_docs, awkward, min_docs):
    rows = [(*r, "en", f"s{i % 3}") for i, r in enumerate(awkward)]
    got = d.audit(make_docs(rows, extra=("row", "term", "n", "docs", "total")), min_docs).collect()
    assert sorted(map(tuple, got)) == brute(rows, min_docs, 50)


def test_empty(make_docs):
    assert d.audit(make_docs([])).count() == 0
