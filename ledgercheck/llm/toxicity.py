"""Toxicity by the nearest labelled examples under TF-IDF cosine, exact on the kept terms.

Terms are words and their first 4 and 5 bytes, lower-cased.  Those kept (at most TERMS) tell the
labels apart on the examples; their document frequencies are counted over all documents.  A text
is the vector of its kept terms, (1 + log count) * idf, scaled to length one.

Examples are at most ROWS_PER_LABEL labelled documents per label, the first by the hash of their
text; those with equal vectors are one entry.  Their inverted index is cut into blocks of BLOCK
entries; each term keeps its largest weight per block.  A query takes blocks by the sum of its
terms' largest weights and stops when the next block can't reach its K-th best, so the K nearest
are exact.  They vote with weight 1 / (1 - cosine + SOFT), each label's examples standing for all
labelled documents of that label.  Votes of examples on the rest of the examples are calibrated to
shares of toxic ones (isotonic regression).  A text without kept terms gets the share of toxic
ones among such examples.

Defined results: null and empty text has no terms.  Several labels of one id count as toxic if one
is; null labels are not learned from.  Without examples of both labels the score is the share of
toxic ones, 0 without any.  Ids, languages and sources never enter a score; ties between examples
go by their vectors.  Rows with equal ids are scored each by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgercheck.llm.common import (fields, packed, scan_texts, settled, sized_broadcast,
                                    string_buffers)
from ledgercheck.llm.tokens import ALNUM, BYTE_CODE, Hasher, words

TERMS = 2048
ROWS_PER_LABEL = 2000
MIN_Z = 5.0        # how sure a kept term tells labels apart, in standard deviations
MIN_ODDS = 4.0     # and how much more often it occurs with one label
PREFIXES = (4, 5)  # bytes
K = 15
SOFT = 0.05
BLOCK = 64
MODEL_BYTES = 64 << 20
FILTER = 1 << 20


def term_hashes(part: pa.RecordBatch, hasher: Hasher):
    """(row, hash) of every term occurrence."""
    data, offsets = string_buffers(part.column("text"))
    w = words(data, offsets, ALNUM, True, hasher)
    rows = np.repeat(np.arange(part.num_rows), w.counts())
    all_rows, codes = [rows], [w.hashes]
    for n in PREFIXES:
        long = np.flatnonzero(w.ends - w.starts > n)
        starts = w.starts[long]
        code = np.full(len(long), n, np.uint64)
        for i in range(n):
            code = code * np.uint64(0x9E3779B97F4A7C15) + BYTE_CODE[w.data[starts + i]]
        all_rows.append(rows[long])
        codes.append(code ^ (code >> np.uint64(29)))
    return np.concatenate(all_rows), np.concatenate(codes)


def known_terms(part: pa.RecordBatch, terms: np.ndarray, seen: np.ndarray, hasher: Hasher):
    """(row, term number, count) of the kept terms of every row, in order."""
    rows, codes = term_hashes(part, hasher)
    maybe = np.flatnonzero(seen[codes & np.uint64(FILTER - 1)])
    if not len(maybe) or not len(terms):
        none = np.zeros(0, np.int64)
        return none, none, none
    rows, codes = rows[maybe], codes[maybe]
    at = np.searchsorted(terms, codes).clip(0, len(terms) - 1)
    hit = terms[at] == codes
    pair, count = np.unique(rows[hit] * len(terms) + at[hit], return_counts=True)
    return pair // len(terms), pair % len(terms), count


def term_filter(terms: np.ndarray) -> np.ndarray:
    seen = np.zeros(FILTER, bool)
    seen[terms & np.uint64(FILTER - 1)] = True
    return seen


def examples(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, dict]:
    """(text, toxic) of the examples, and the number of labelled documents per label."""
    own = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # only hashes are joined and ranked; at most 2 * ROWS_PER_LABEL texts are fetched by theirs
    h = F.xxhash64("text").alias("_h")
    marked = docs.select("doc_id", h).join(own, "doc_id").select("toxic", "_h")
    total = {int(r[0]): r[1] for r in marked.groupBy("toxic").count().collect()}
    order = Window.partitionBy("toxic").orderBy("_h")
    chosen = marked.distinct().withColumn("_n", F.row_number().over(order)).where(
        F.col("_n") <= rows).drop("_n")
    return docs.select("text", h).join(F.broadcast(chosen), "_h").dropDuplicates(
        ["toxic", "_h"]).select("text", "toxic"), total


def choose_terms(sample: DataFrame, n: tuple[int, int]) -> np.ndarray:
    """Hashes of the kept terms, in order."""
    hasher = Hasher()

    def count(part: pa.RecordBatch) -> dict:
        rows, codes = term_hashes(part, hasher)
        toxic = np.asarray(part.column("toxic")) == 1
        order = np.lexsort((codes, rows))
        rows, codes = rows[order], codes[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])
        term, place = np.unique(codes[new], return_inverse=True)
        return {"term": term.view(np.int64),
                "a": np.bincount(place, toxic[rows[new]], len(term)).astype(np.int64),
                "b": np.bincount(place, ~toxic[rows[new]], len(term)).astype(np.int64)}

    counts = scan_texts(sample, count, fields("term long, a long, b long")).groupBy("term").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"))
    share_a, share_b = (F.col("a") + 0.5) / (n[1] + 1.0), (F.col("b") + 0.5) / (n[0] + 1.0)
    both = (F.col("a") + F.col("b")) / float(n[0] + n[1])
    z = F.abs(F.col("a") / float(n[1]) - F.col("b") / float(n[0])) / F.sqrt(
        both * (1 - both) * (1 / n[0] + 1 / n[1]) + 1e-12)
    odds = F.greatest(share_a / share_b, share_b / share_a)
    best = counts.where((z >= MIN_Z) & (odds >= MIN_ODDS)).orderBy(F.desc(z), "term").limit(TERMS)
    return np.sort(np.array([r["term"] for r in best.select("term").collect()],
                            np.int64).view(np.uint64))


def frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """Document frequencies of the kept terms over all documents, and their number."""
    shared = docs.sparkSession.sparkContext.broadcast((terms, term_filter(terms)))
    hasher = Hasher()

    def count(part: pa.RecordBatch) -> dict:
        _, at, _ = known_terms(part, *shared.value, hasher)
        own, n = np.unique(at, return_counts=True)
        return {"term": np.append(own, -1), "n": np.append(n, part.num_rows)}

    found = scan_texts(docs.select("text"), count, fields("term int, n long")).groupBy("term").agg(
        F.sum("n").alias("n")).collect()
    df, total = np.zeros(len(terms), np.int64), 0
    for term, n in found:
        if term < 0:
            total = n
        else:
            df[term] = n
    return df, total


def vectors(rows, at, count, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, weights) per row of a slice that has any, in order of rows."""
    cuts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else []
    ends = np.append(cuts[1:], len(rows)) if len(rows) else []
    out = []
    for a, b in zip(cuts, ends):
        weight = (1 + np.log(count[a:b])) * idf[at[a:b]]
        out.append((at[a:b], weight / np.sqrt((weight ** 2).sum())))
    return out


class BlockMax:
    """Inverted index of the examples with the largest weight of each term per block."""

    def __init__(self, entries: list, votes: np.ndarray, n_terms: int) -> None:
        """`entries`: (terms, weights); `votes`: (weight of toxic, weight of other) each."""
        self.votes, self.n = votes, len(entries)
        self.blocks = -(-self.n // BLOCK)
        owner = np.repeat(np.arange(self.n), [len(t) for t, _ in entries])
        term = np.concatenate([t for t, _ in entries]) if entries else np.zeros(0, int)
        weight = np.concatenate([x for _, x in entries]) if entries else np.zeros(0)
        order = np.lexsort((owner, term))
        self.owner, self.weight, term = owner[order], weight[order], term[order]
        cell = term * max(1, self.blocks) + self.owner // BLOCK
        self.cuts = np.searchsorted(cell, np.arange(n_terms * max(1, self.blocks) + 1))
        top = np.zeros(n_terms * max(1, self.blocks))
        np.maximum.at(top, cell, self.weight)
        self.top = top.reshape(n_terms, max(1, self.blocks))

    def nearest(self, terms, weights, k: int, without: int = -1):
        """Entries and cosines of the k nearest with a term in common; ties to the first."""
        bound = weights @ self.top[terms]
        at, score, least = np.zeros(0, int), np.zeros(0), 0.0
        for block in np.argsort(-bound, kind="stable").tolist():
            # a whole block can't enter any more
            if bound[block] <= 0 or len(at) == k and bound[block] < least - 1e-12:
                break
            scores = np.zeros(BLOCK)
            for t, x in zip(terms.tolist(), weights.tolist()):
                cell = t * self.blocks + block
                lo, hi = self.cuts[cell], self.cuts[cell + 1]
                if hi > lo:
                    scores[self.owner[lo:hi] - block * BLOCK] += x * self.weight[lo:hi]
            own = np.flatnonzero(scores > 0)
            own = own[own + block * BLOCK != without]
            at = np.concatenate([at, own + block * BLOCK])
            score = np.concatenate([score, scores[own]])
            order = np.lexsort((at, -score))[:k]
            at, score = at[order], score[order]
            least = score[-1] if len(at) == k else 0.0
        return at, score

    def vote(self, terms, weights, k: int = K, without: int = -1):
        """Weighted share of toxic ones among the nearest, and the nearest themselves."""
        at, score = self.nearest(terms, weights, k, without)
        if not len(at):
            return None, at, score
        weight = 1 / (1 - np.minimum(score, 1) + SOFT)
        toxic, other = (self.votes[at] * weight[:, None]).sum(0)
        return toxic / (toxic + other), at, score


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing fit of y on x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    levels: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order]):
        levels.append([a, a, b * c, c])
        while len(levels) > 1 and (levels[-2][2] * levels[-1][3] >= levels[-1][2] * levels[-2][3]
                                   or levels[-2][1] == levels[-1][0]):
            last = levels.pop()
            levels[-1] = [levels[-1][0], last[1], levels[-1][2] + last[2], levels[-1][3] + last[3]]
    points = [(p, s / n) for lo, hi, s, n in levels for p in ((lo, hi) if hi > lo else (lo,))]
    return np.array([p for p, _ in points]), np.array([v for _, v in points])


def learn(docs: DataFrame, labelled: DataFrame, labels: DataFrame,
          rows: int = ROWS_PER_LABEL) -> dict:
    """The model: `docs` gives frequencies, `labelled` (a part of them) the examples."""
    sample, total = examples(labelled, labels, rows)
    sample = settled(sample, "examples")
    n = {int(r[0]): r[1] for r in sample.groupBy("toxic").count().collect()}
    everyone = sum(total.values())
    prior = total.get(1, 0) / everyone if everyone else 0.0
    if not n.get(0) or not n.get(1):
        return {"prior": prior}
    terms = choose_terms(sample, (n[0], n[1]))
    df, n_docs = frequencies(docs, terms)
    idf = np.log((n_docs + 1) / (df + 1)) + 1
    found = sample.select("text", "toxic")
    seen, hasher = term_filter(terms), Hasher()

    def describe(part: pa.RecordBatch) -> dict:
        rows, at, count = known_terms(part, terms, seen, hasher)
        cuts = np.searchsorted(rows, np.arange(part.num_rows + 1))
        return {"toxic": part.column("toxic").cast(pa.int32()),
                "at": [at[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])],
                "count": [count[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]}

    described = scan_texts(found, describe, fields("toxic int, at array<int>, count array<int>"))
    weight = {c: total[c] / n[c] for c in (0, 1)}  # labelled documents an example stands for
    entries: dict[tuple, np.ndarray] = {}
    blank = np.zeros(2)
    for r in described.collect():
        vote = np.array([weight[1], 0.0]) if r["toxic"] == 1 else np.array([0.0, weight[0]])
        if r["at"]:
            key = (tuple(r["at"]), tuple(r["count"]))
            entries[key] = entries.get(key, np.zeros(2)) + vote
        else:
            blank = blank + vote
    # like vectors side by side, so that blocks have tight bounds
    keys = sorted(entries, key=lambda e: (max(e[0], key=lambda t: (idf[t], t)), e))
    made = []
    for at, count in keys:
        w = (1 + np.log(np.array(count))) * idf[list(at)]
        made.append((np.array(at), w / np.sqrt((w ** 2).sum())))
    index = BlockMax(made, np.array([entries[e] for e in keys]).reshape(-1, 2), len(terms))
    x, y, w = [], [], []
    for i, (at, weights) in enumerate(made):  # each entry by the others
        share, _, _ = index.vote(at, weights, without=i)
        if share is not None:
            toxic, other = index.votes[i]
            x.append(share)
            y.append(toxic / (toxic + other))
            w.append(toxic + other)
    points = isotonic(np.array(x), np.array(y), np.array(w)) if x else (np.array([0, 1]),) * 2
    return {"prior": prior, "blank": float(blank[0] / blank.sum()) if blank.sum() else prior,
            "terms": terms, "seen": seen, "idf": idf, "index": index, "points": points}


def model_bytes(model: dict) -> int:
    index = model.get("index")
    arrays = [model.get("terms"), model.get("seen"), model.get("idf"),
              *((index.owner, index.weight, index.cuts, index.top, index.votes) if index else ())]
    return sum(a.nbytes for a in arrays if a is not None)


def score(docs: DataFrame, model: dict, k: int = K) -> DataFrame:
    """`row` (all columns but text), score and the evidence: cosine and toxic share of the
    nearest example, and how many examples voted."""
    shared = sized_broadcast(docs.sparkSession, model, model_bytes(model), MODEL_BYTES,
                             "toxicity model")
    hasher = Hasher()

    def work(part: pa.RecordBatch) -> dict:
        m = shared.value
        n = part.num_rows
        out = np.full(n, m.get("blank", m["prior"]))
        cosine, toxic, voters = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        if "index" in m and m["index"].n:
            rows, at, count = known_terms(part, m["terms"], m["seen"], hasher)
            memo: dict[bytes, tuple] = {}
            for row, (terms, weights) in zip(np.unique(rows).tolist(),
                                             vectors(rows, at, count, m["idf"])):
                key = terms.tobytes() + weights.tobytes()
                if key not in memo:
                    share, near, score = m["index"].vote(terms, weights, k)
                    if share is None:
                        memo[key] = (m["blank"], 0.0, 0.0, 0)
                    else:
                        level = float(np.interp(share, *m["points"]))
                        votes = m["index"].votes[near[0]]
                        # the raw share orders texts of one calibrated level
                        memo[key] = (0.99 * level + 0.01 * share, float(min(score[0], 1.0)),
                                     votes[0] / votes.sum(), len(near))
                out[row], cosine[row], toxic[row], voters[row] = memo[key]
        return {"row": part.column("row"), "score": out.clip(0, 1), "nearest_cosine": cosine,
                "nearest_toxic": toxic, "voters": voters}

    rows = packed(docs)
    return scan_texts(rows, work, fields("score double, nearest_cosine double, "
                                         "nearest_toxic double, voters long", rows.schema["row"]))
