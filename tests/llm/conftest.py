import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# columns whose names operators use for results of their own
CLASHING = ("row", "score", "node", "n_words", "key", "slot", "kept", "spans")


@pytest.fixture
def make_docs(spark):
    """documents of (id, text) or (id, text, lang, source), with further columns that clash."""
    def make(rows, extra=CLASHING):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s",
                 None if r[1] is None else len(r[1]), *(f"{c}-{i}" for c in extra))
                for i, r in enumerate(rows)]
        return spark.createDataFrame(full, ", ".join([COLUMNS, *(f"{c} string" for c in extra)]))

    return make


@pytest.fixture
def awkward():
    """Null, empty, blank, no letters, very long, repeated, shared ids, null id."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "!?.,"), (5, long), (6, "one two"),
            (7, "one two"), (7, "one two"), (8, "x" * 300_000), (9, "née Über 日本 \U0001F600"),
            (None, "three four five six"), (7, "another text of the same id"), (10, "one\x00two")]


def texts(seed, n, words=40, alphabet=12):
    """Random texts over few words, so that runs of words repeat."""
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(alphabet)}" for _ in range(rng.randrange(words)))
            for _ in range(n)]


@pytest.fixture
def random_texts():
    return texts
