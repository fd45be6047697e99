import random

import numpy as np

from ledgercheck.llm import langid

WORDS = {"en": "the of and that with from thing", "de": "der die und schön über nicht zu",
         "fr": "le la été où être avec que", "es": "el los ción niño para que está"}


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(6, 60))),
             lang, "s") for i in range(n) for lang in [rng.choice(sorted(WORDS))]]


def test_languages_of_other_rows(make_docs, awkward):
    model = langid.learn(make_docs(corpus(300)))
    held = corpus(200, 2)
    got = langid.identify(make_docs(held + [(1000, "123 !?", "en", "s"), (1001, None), (1002, "")]),
                          model).collect()
    by_id = {r["row"]["doc_id"]: r for r in got}
    assert np.mean([by_id[i]["lang_pred"] == lang for i, _, lang, _ in held]) > 0.97
    for i in (1000, 1001, 1002):
        assert by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0
    out = langid.identify(make_docs(awkward), model).collect()
    assert len(out) == len(awkward) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["lang_pred"] for r in out} <= {*WORDS, "und"}


def test_one_language_or_none(make_docs):
    docs = make_docs([(1, "abc", "en"), (2, "123", "en"), (3, "abc", None)])
    one = langid.identify(docs, langid.learn(docs)).collect()
    assert sorted((r["row"]["doc_id"], r["lang_pred"]) for r in one) == [
        (1, "en"), (2, "und"), (3, "en")]
    none = langid.learn(make_docs([]))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(make_docs([]), none).count() == 0


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 12, 40):
        code = langid.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n < 3 else 2)


def test_long_rows_are_summed_in_pieces(monkeypatch):
    raw = np.frombuffer(("the quick où " * 300).encode(), np.uint8)
    cuts = np.array([0, 5, 5, 1000, len(raw)])
    whole = langid.features(raw, cuts)
    monkeypatch.setattr(langid, "PIECE", 97)
    assert np.allclose(langid.features(raw, cuts), whole)


def test_hundreds_of_languages(make_docs, monkeypatch):
    """More label values than the sample has rows for, and more than codes are compared for."""
    monkeypatch.setattr(langid, "SAMPLE_TEXTS", 300)
    monkeypatch.setattr(langid, "COMPARED", 100)
    rows = [(4 * i + k, f"{own} {own} {own} {own}", f"l{i:03d}", "s")
            for i in range(400) for k in range(4)
            for own in [f"{chr(97 + i % 26)}{chr(97 + i // 26)}q{chr(97 + i * 7 % 26)}"]]
    model = langid.learn(make_docs(rows))
    assert len(model["names"]) == 400 and model["code"].shape[0] == 400
    got = langid.identify(make_docs(rows[::4]), model).collect()
    assert np.mean([r["lang_pred"] == r["row"]["lang"] for r in got]) > 0.9


def test_sample_of_a_large_language_is_the_lowest_hashes(spark, make_docs):
    from pyspark.sql import functions as F

    from ledgercheck.llm.common import sample_by_hash

    docs = make_docs([(i, f"text {i % 5000}", "en" if i % 50 else "de", "s")
                      for i in range(6000)])
    got = {(r["lang"], r["text"]) for r in sample_by_hash(docs, "text", 20, ("lang",)).collect()}
    rows = sorted({(r["lang"], r["h"], r["text"]) for r in docs.select(
        "lang", "text", F.xxhash64("text").alias("h")).collect()})
    for lang in ("en", "de"):
        lowest = [r for r in rows if r[0] == lang][:20]
        assert {t for x, t in got if x == lang} == {t for _, _, t in lowest}
