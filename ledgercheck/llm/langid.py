"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier per bit, a logistic regression on hashed
byte n-grams of the whole text, predicts that bit.  A text gets the language whose codeword has
the least loss, each bit weighted by how well its classifier does on rows held back from fitting.
Texts whose best two codewords are close are flagged ambiguous.

The classifiers are fitted on at most ROWS_PER_LANGUAGE labelled rows of each language, and on
short passages of them; the rows are the first by the hash of their text.  All languages share
SAMPLE_TEXTS rows, but each has one.  One task fits them and holds the rows by their non-zero
features.  Everything else covers all rows.

Defined results: text that is null or has no letter is `und` with score 0 and not ambiguous; with
no labelled row at all every text is `und`; with one language every text with a letter gets it.
Any number of label values is learned (the codewords are broadcast: about 190 000 fill their bound).
Very long texts are taken whole, in pieces of PIECE bytes.  Equal texts are fitted on once.
Labels that are null are not learned from.  Ties go to the first language by name.  Ids, sources
and labels never enter a prediction; other columns are passed through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgercheck.llm.common import (fields, fit_in_task, packed, sample_by_hash, scan_texts,
                                    sized_broadcast, string_buffers)

ROWS_PER_LANGUAGE = 400
SAMPLE_TEXTS = 25_600    # of all languages; with more languages than that, one text of each
COMPARED = 512           # up to so many languages the best of some drawn codes is taken
DIMENSIONS = 4096
ORDERS = (1, 2, 3, 4)   # lengths of n-grams, in bytes
PASSAGES = (24, 80)     # lengths of the short passages fitted on, in bytes
STEPS = 60
PIECE = 1 << 18
AMBIGUOUS = 0.6         # share of the best codeword below which a text is ambiguous
ROWS_AT_ONCE = 128
MODEL_BYTES = 32 << 20

LETTER = re.compile(r"[^\W\d_]")
FOLD = np.full(256, 32, np.uint8)  # letters lower-cased, other ASCII as one separator
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts of every row, square-rooted and scaled to length one."""
    rows, total = len(offsets) - 1, len(data)
    counts = np.zeros(rows * DIMENSIONS, np.float32)
    for lo in range(0, total, PIECE):  # pieces bound the memory for one very long row
        hi = min(total, lo + PIECE)
        folded = FOLD[data[lo:min(total, hi + max(ORDERS) - 1)]].astype(np.uint64)
        row = np.searchsorted(offsets, np.arange(lo, hi), side="right") - 1
        left = offsets[row + 1] - np.arange(lo, hi)
        code = np.zeros(len(folded), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if len(folded) < n:
                break
            code = (code[:len(folded) - n + 1] << np.uint64(8)) | folded[n - 1:]
            if n in ORDERS:
                at = np.flatnonzero(left[:len(code)] >= n)
                hashed = ((code[at] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) \
                    >> np.uint64(64 - DIMENSIONS.bit_length() + 1)
                counts += np.bincount(row[at] * DIMENSIONS + hashed.astype(np.int64),
                                      minlength=len(counts))
    out = np.sqrt(counts).reshape(rows, DIMENSIONS)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def blocks(part: pa.RecordBatch):
    """Features of a few rows at a time."""
    for lo in range(0, part.num_rows, ROWS_AT_ONCE):
        piece = part.slice(lo, ROWS_AT_ONCE)
        data, offsets = string_buffers(piece.column("text"))
        yield piece, features(data, offsets)


def codewords(n: int) -> np.ndarray:
    """Rows of +1 and -1, one per language, well apart.

    Up to 5 languages every split of them is a bit; beyond, the best of 64 drawn codes, and of
    very many the first one: their rows are too many to be compared, and far apart anyway."""
    if n <= 5:
        bits = [[1 if (split >> i) & 1 else -1 for i in range(n)]
                for split in range(1, 1 << (n - 1))] or [[1] * n]
        return np.array(bits, np.float32).T
    length, best = 10 * int(np.ceil(np.log2(n))), None
    for seed in range(64 if n <= COMPARED else 1):
        code = np.random.default_rng(seed).choice([-1, 1], (n, length)).astype(np.float32)
        if n > COMPARED:
            return code
        apart = (length - code @ code.T) / 2
        worst = (apart + length * np.eye(n)).min()
        if best is None or worst > best[0]:
            best = (worst, code)
    return best[1]


class Rows:
    """Feature rows kept by their non-zero entries; a few at a time become a dense matrix."""

    def __init__(self, entries: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.entries = entries
        self.mean = np.zeros(DIMENSIONS, np.float32)
        for at, value in entries:
            self.mean[at] += value / np.float32(max(1, len(entries)))

    def dense(self, chosen: np.ndarray):
        """(rows, matrix less the mean) for ROWS_AT_ONCE of the chosen rows at a time."""
        for lo in range(0, len(chosen), ROWS_AT_ONCE):
            some = chosen[lo:lo + ROWS_AT_ONCE]
            x = np.zeros((len(some), DIMENSIONS), np.float32)
            for i, r in enumerate(some):
                x[i, self.entries[r][0]] = self.entries[r][1]
            yield some, x - self.mean


def _logistic(rows: Rows, chosen: np.ndarray, y: np.ndarray, ridge: float = 1e-5) -> np.ndarray:
    """Weights of one logistic regression per column of y (+1 or -1), by accelerated descent."""
    w = np.zeros((DIMENSIONS, y.shape[1]), np.float32)
    look, momentum = w.copy(), 1.0
    for _ in range(STEPS):
        gradient = ridge * look
        for some, x in rows.dense(chosen):
            margin = np.clip((x @ look) * y[some], -30, 30)
            gradient += x.T @ (-y[some] / (1 + np.exp(margin))) / np.float32(len(chosen))
        new = look - 4.0 * gradient.astype(np.float32)
        following = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        look = new + np.float32((momentum - 1) / following) * (new - w)
        w, momentum = new, following
    return w


def _fit(found: list[dict]) -> dict:
    """The model, from rows of lang and features (at, value)."""
    names = sorted({r["lang"] for r in found})
    if len(names) < 2:
        return {"names": names}
    found.sort(key=lambda r: (r["lang"], r["at"], r["value"]))
    rows = Rows([(np.frombuffer(r["at"], np.int16), np.frombuffer(r["value"], np.float32))
                 for r in found])
    number = {name: i for i, name in enumerate(names)}
    code = codewords(len(names))
    y = code[np.array([number[r["lang"]] for r in found])]
    every = np.arange(len(found))
    held = every % 5 == 0
    tried = _logistic(rows, every[~held], y)
    right = sum((((x @ tried) * y[some]) > 0).sum(0) for some, x in rows.dense(every[held]))
    right = right / held.sum()
    weight = np.log((right + 0.01) / (1.01 - right)).clip(0.05)  # odds that a bit is right
    return {"names": names, "code": code.astype(np.int8), "mean": rows.mean,
            "weights": _logistic(rows, every, y), "bit": (weight / weight.sum()).astype(np.float32)}


def learn(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> dict:
    """The model, from `text` and `lang` of the rows given (null languages are left out)."""
    def work(part: pa.RecordBatch) -> dict:
        out = {"text": [], "lang": [], "at": [], "value": []}
        for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
            raw = text.encode()
            # the whole text, and short passages from its middle
            cuts = [raw] + [raw[max(0, len(raw) // 2 - n // 2):][:n] for n in PASSAGES]
            for cut in cuts:
                row = features(np.frombuffer(cut, np.uint8), np.array([0, len(cut)]))[0]
                at = np.flatnonzero(row)
                out["text"].append("")
                out["lang"].append(lang)
                out["at"].append(at.astype(np.int16).tobytes())
                out["value"].append(row[at].astype(np.float32).tobytes())
        return out

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "text", "lang")
    n = rows.select("lang").distinct().count()
    sample = sample_by_hash(rows, "text", max(1, min(rows_per_language, SAMPLE_TEXTS // max(1, n))),
                            ("lang",))
    return fit_in_task(scan_texts(sample.select("text", "lang"), work,
                                  fields("text string, lang string, at binary, value binary"))
                       .select("lang", "at", "value"), _fit)


def predict(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language with the least weighted loss, and its share."""
    margin = (x - model["mean"]) @ model["weights"]
    code, bit = model["code"], model["bit"] * model["code"].shape[1]
    loss = np.stack([(np.log1p(np.exp(-np.clip(margin * row, -30, 30))) * bit).sum(1)
                     for row in code], 1)
    share = np.exp(loss.min(1, keepdims=True) - loss)
    return loss.argmin(1), 1 / share.sum(1)


def identify(docs: DataFrame, model: dict, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """`row` (all columns but text), text, lang_pred, score and ambiguous for every row."""
    size = sum(v.nbytes for v in model.values() if isinstance(v, np.ndarray))
    shared = sized_broadcast(docs.sparkSession, model, size, MODEL_BYTES, "language model")

    def work(part: pa.RecordBatch) -> dict:
        m = shared.value
        names, scores, unsure = [], [], []
        for piece, x in blocks(part):
            letters = np.array([t is not None and LETTER.search(t) is not None
                                for t in piece.column("text").to_pylist()])
            if len(m["names"]) < 2:
                best, share = np.zeros(len(x), int), np.ones(len(x))
            else:
                best, share = predict(x, m)
            known = letters & bool(m["names"])
            names += [m["names"][b] if k else "und" for b, k in zip(best.tolist(), known)]
            scores += np.where(known, share.clip(0, 1), 0.0).tolist()
            unsure += (known & (share < ambiguous)).tolist()
        return {"row": part.column("row"), "text": part.column("text"), "lang_pred": names,
                "score": scores, "ambiguous": unsure}

    rows = packed(docs)
    return scan_texts(rows, work, fields("text string, lang_pred string, score double, "
                                         "ambiguous boolean", rows.schema["row"]))
