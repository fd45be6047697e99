import hashlib
import random
import re

import numpy as np

from ledgercheck.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d)
                for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True,
                    16 <= len(digits) <= 19 and luhn(digits), 8 <= len(digits) <= 15][kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(7)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@+- _%0()2545é") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute(text)
    assert pii.base_spans("4111 1111 1111 1111") == [(2, 0, 19)]
    # long runs stay fast
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 200_000) == []


def model(make_docs):
    return pii.learn(make_docs([(i, f"call +1 (976) 555-{i:04d} or mail u{i}@ex{i}.com, {i} times")
                                for i in range(200)]))


def test_all_spans_and_digest(make_docs, awkward):
    rows = awkward + [
        (20, "éé mail a.b@c.de and 10.0.0.255 or 10.0.0.256"),
        (21, "ring +49 151 2345 6789 now. " + "pad " * 50 + "again: +49 151 2345 6789"),
        (22, "plain 1234567890123456 digits, version 2.0 of 1999")]
    docs = make_docs(rows)
    got = [r.asDict(True) for r in pii.find_pii(docs, model(make_docs)).collect()]
    assert len(got) == len(rows)
    by_id = {r["row"]["doc_id"]: r for r in got}
    for doc, text in rows:
        if sum(d == doc for d, _ in rows) == 1:
            base, r = brute(text), by_id[doc]
            assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [
                sum(s[0] == k for s in base) for k in range(4)]
            assert r["base_sha256"] == hashlib.sha256(pii.spans_text(base).encode()).hexdigest()
            assert set(pii.spans_text(base).split(",")) <= set(r["spans"].split(","))
    assert by_id[22]["spans"] == "" and by_id[1]["spans"] == ""


def test_repeated_tokens_share_their_label(make_docs):
    # the second mention lacks the sign the pattern needs
    text = "Call +1 (976) 555-0029 soon. " + "word " * 60 + "So (976) 555-0029 it is."
    spans = [pii.base_spans(text)]
    added = pii.added_spans([text], spans, model(make_docs))[0]
    assert spans[0] == [(3, 5, 22)]
    for kind, a, b in added:
        assert kind == 3 and "555-0029" in text[a:b] and a > 300


def test_every_repeat_has_the_label_of_the_observed():
    # alone, a token is no personal data (e^3 to one)
    field = {"node": np.zeros((pii.DIMENSIONS, pii.LABELS)), "chain": np.zeros((pii.LABELS,) * 2),
             "skip": np.eye(pii.LABELS) * 7 - 3}
    field["node"][:, 0] = 0.5
    field["skip"][0, 0] = 0.2
    gap, sign = "word " * 10, "call +1 (976) 555-0029. "
    other = "part 555-0029 " + gap
    for text in (sign + gap + other * 100, other * 100 + sign, other * 50 + sign + gap + other * 50):
        spans = [pii.base_spans(text)]
        assert len(spans[0]) == 1
        added = pii.added_spans([text], spans, field)[0]
        assert len(added) == 100
        assert all(k == 3 and text[a:b] == "555-0029" for k, a, b in added)
    assert pii.added_spans([other * 100], [[]], field) == [[]]


def test_messages_settle_over_long_chains():
    """Evidence at one end of a run of 300 tokens reaches the other."""
    field = {"node": np.zeros((pii.DIMENSIONS, pii.LABELS)),
             "chain": np.eye(pii.LABELS) * 12, "skip": np.zeros((pii.LABELS,) * 2)}
    text = "a@b.cd " + "7 " * 300
    graph = pii.graph_of([text], [pii.base_spans(text)])
    p = pii.beliefs(graph, field)
    # exact on a chain: the power of its transition
    step = np.exp(field["chain"]) / np.exp(field["chain"]).sum(1, keepdims=True)
    free = [i for i, x in enumerate(graph.label) if x == 0]
    assert len(free) == 300
    for k in (0, 9, 150, 299):
        assert np.allclose(p[free[k]], np.linalg.matrix_power(step, k + 1)[1], atol=1e-3)


def test_redaction(make_docs):
    docs = make_docs([(1, "mail a@b.cd or +1 976 555 0029 é"), (2, "nothing"), (3, None), (4, "")])
    out = pii.redact(docs, model(make_docs))
    assert out.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["spans"]) for r in out.collect()}
    assert got[1] == ("mail [EMAIL] or [PHONE] é", 25, "spans-0")
    assert got[2][0] == "nothing" and got[3][0] is None and got[4][0] == ""


def test_empty_table(make_docs):
    docs = make_docs([])
    assert pii.find_pii(docs, pii.learn(docs)).count() == 0
