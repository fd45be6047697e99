"""Token counts under a unigram vocabulary: dynamic programming over a shared trie.

A text is cut into pre-tokens at ASCII white space, each with a mark in front.  Its tokens are the
pieces of the best-scored segmentation of every pre-token; equally good ones take the fewer
pieces.  Distinct pre-tokens of a task are put into a trie, level by level; the forward score of a
trie node (the best score of a segmentation of that prefix) is computed once, for all pre-tokens
that share it, and the number of pieces is kept at the node a pre-token ends at.  Pre-tokens a
task has met before are looked up; the memory of them is emptied when it reaches KNOWN_WORDS.
A trie has a level per byte, so a pre-token of more than LONG bytes, which shares little, has its
forward scores computed by itself: in blocks of BLOCK bytes, whose pieces are found at once, with
the scores of the last bytes carried over.  The result is the same at any length.

Pieces come from a sentencepiece file, whose path is a parameter; its order gives their scores:
the piece of rank r has the logarithm of 1 / (r + 2.7), scaled to whole numbers.  Bytes that no
piece covers count as one token each.  Nothing is trained.

Defined results: null and empty text has no tokens.  Very long texts and pre-tokens are counted
whole.  Rows with equal ids are counted each by itself; other columns are not read.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgercheck.llm.common import fields, scan_texts, sized_broadcast, string_buffers
from ledgercheck.llm.tokens import BASE, BYTE_CODE, NOT_SPACE, Hasher, mix, powers, words

LONG = 1024             # bytes from which a pre-token is counted by itself
BLOCK = 1 << 16         # bytes of it whose pieces are looked for at once
MANY = 1 << 40          # the count of pieces of a long one, as the low part of its value
KNOWN_WORDS = 2_000_000
SCALE = 1000.0
PENALTY = 10_000        # a byte on its own scores this much below the least piece
FEWER = 1 << 13         # ties in score: the count of pieces is the low part of the value
VOCABULARY_BYTES = 16 << 20
FILTER = 1 << 20


class Vocabulary:
    """Hashes of pieces in order, with their value, and a filter on their low bits."""

    def __init__(self, pieces: dict[bytes, int]) -> None:
        self.lengths = sorted({len(p) for p in pieces})
        codes = np.array([int(piece_hash(p)) for p in pieces], np.uint64)
        order = np.argsort(codes)
        self.codes = codes[order]
        scores = np.array(list(pieces.values()), np.int64)
        self.values = scores[order] * FEWER - 1
        self.byte = (int(scores.min()) - PENALTY) * FEWER - 1
        self.seen = np.zeros(FILTER, bool)
        self.seen[self.codes & np.uint64(FILTER - 1)] = True

    def size(self) -> int:
        return self.codes.nbytes + self.values.nbytes + self.seen.nbytes


def piece_hash(piece: bytes) -> np.uint64:
    code = np.uint64(0)
    with np.errstate(over="ignore"):
        for b in piece:
            code = code * BASE + BYTE_CODE[b]
    return mix(np.array([code]))[0]


def read_pieces(path: str) -> dict[bytes, int]:
    """Pieces as bytes with their whole-number scores; the word mark is a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked = sorted((i for i in range(model.get_piece_size())
                     if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))),
                    key=lambda i: (-model.get_score(i), i))
    total = np.log(sum(1 / (r + 2.7) for r in range(len(ranked))))
    out: dict[bytes, int] = {}
    for r, i in enumerate(ranked):
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        out.setdefault(piece, round(-SCALE * float(np.log(r + 2.7) + total)))
    return out


def count_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Pieces in the best segmentation of every pre-token: one trie over all of them.

    `data` holds the pre-tokens with their marks."""
    n, top = len(starts), max(v.lengths)
    out = np.zeros(n, np.int64)
    up = powers(BASE, top + 1)
    live, depth = np.arange(n), 0
    code = np.zeros(n, np.uint64)            # hash of the prefix, per live pre-token
    node = np.zeros(n, np.int64)             # its node among those of this depth
    # per depth, latest first: prefix hash and forward value of the nodes
    codes, values = deque([np.zeros(1, np.uint64)], top), deque([np.zeros(1, np.int64)], top)
    above = deque(maxlen=top)                # node -> its parent's node
    while len(live):
        code = code * BASE + BYTE_CODE[data[starts[live] + depth]]
        own, first, place = np.unique(code, return_index=True, return_inverse=True)
        parent = node[first]
        node, depth = place, depth + 1
        above.appendleft(parent)
        # forward values: the last piece of the prefix has 1, 2, ... bytes
        value = values[0][parent] + v.byte
        back = np.arange(len(own))
        for length in range(1, min(depth, top) + 1):
            back = above[length - 1][back]   # ancestor `length` levels up
            if length not in v.lengths:
                continue
            piece = mix(own - codes[length - 1][back] * up[length])
            maybe = np.flatnonzero(v.seen[piece & np.uint64(FILTER - 1)])
            at = np.searchsorted(v.codes, piece[maybe]).clip(0, len(v.codes) - 1)
            hit = v.codes[at] == piece[maybe]
            maybe, at = maybe[hit], at[hit]
            np.maximum.at(value, maybe, values[length - 1][back[maybe]] + v.values[at])
        codes.appendleft(own)
        values.appendleft(value)
        done = ends[live] - starts[live] == depth
        out[live[done]] = -value[node[done]] % FEWER  # the low part counts pieces
        live, code, node = live[~done], code[~done], node[~done]
    return out


def count_long(text: np.ndarray, v: Vocabulary) -> int:
    """Pieces in the best segmentation of one long pre-token with its mark."""
    top, byte = v.lengths[-1], (v.byte + 1) // FEWER * MANY - 1
    start, values = 0, [0]   # values[i]: forward value of the first start + i bytes
    for lo in range(0, len(text), BLOCK):
        hi = min(len(text), lo + BLOCK)
        part = BYTE_CODE[text[start:hi]]
        code, found = np.zeros(len(part), np.uint64), []
        for length in range(1, min(top, len(part)) + 1):
            code = code[:len(part) - length + 1] * BASE + part[length - 1:]
            if length not in v.lengths:
                continue
            piece = mix(code)
            begin = np.flatnonzero(v.seen[piece & np.uint64(FILTER - 1)])
            begin = begin[begin + length > lo - start]   # pieces that end in this block
            at = np.searchsorted(v.codes, piece[begin]).clip(0, len(v.codes) - 1)
            hit = v.codes[at] == piece[begin]
            found.append((begin[hit] + length, begin[hit], v.values[at[hit]]))
        ends, begins, scores = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(ends, kind="stable")
        ends, begins = ends[order].tolist(), begins[order].tolist()
        scores = ((scores[order] + 1) // FEWER).tolist()
        at, n = 0, len(ends)
        for i in range(lo - start + 1, hi - start + 1):
            best = values[i - 1] + byte
            while at < n and ends[at] == i:
                best = max(best, values[begins[at]] + scores[at] * MANY - 1)
                at += 1
            values.append(best)
        following = max(0, hi - top)
        values, start = values[following - start:], following
    return -values[-1] % MANY


class Counter:
    """Counts of the pre-tokens a task has met."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.hasher = vocabulary, Hasher()
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def counts_of(self, hashes, data, starts, ends) -> np.ndarray:
        distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct).clip(0, max(0, len(self.known) - 1))
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            rows = first[new]
            lo, hi = starts[rows], ends[rows]
            sizes = hi - lo + 1   # with the mark: a space before every pre-token
            short = np.flatnonzero(sizes <= LONG)
            tops = np.cumsum(sizes[short])
            text = np.full(int(tops[-1]) if len(tops) else 0, 32, np.uint8)
            source = np.repeat(lo[short] - (tops - sizes[short]) - 1, sizes[short]) + np.arange(
                len(text))
            inside = np.ones(len(text), bool)
            inside[tops - sizes[short]] = False
            text[inside] = data[source[inside]]
            counted = np.zeros(len(rows), np.int64)
            if len(short):
                counted[short] = count_pieces(text, tops - sizes[short], tops, self.vocabulary)
            for i in np.flatnonzero(sizes > LONG).tolist():
                counted[i] = count_long(np.append(np.uint8(32), data[lo[i]:hi[i]]),
                                        self.vocabulary)
            if len(self.known) + len(rows) > KNOWN_WORDS:
                self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                return self.counts_of(hashes, data, starts, ends) if len(distinct) > len(rows) \
                    else counted[place]
            merged = np.concatenate([self.known, distinct[new]])
            order = np.argsort(merged, kind="stable")
            self.known = merged[order]
            self.counts = np.concatenate([self.counts, counted])[order]
        return self.counts[np.searchsorted(self.known, distinct)][place]


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every row of `docs` (doc_id, text)."""
    v = Vocabulary(read_pieces(vocabulary_path))
    shared = sized_broadcast(docs.sparkSession, v, v.size(), VOCABULARY_BYTES, "vocabulary")
    kept: dict[str, Counter] = {}

    def work(part: pa.RecordBatch) -> dict:
        if not kept:  # once per task
            kept["counter"] = Counter(shared.value)
        counter = kept["counter"]
        data, offsets = string_buffers(part.column("text"))
        w = words(data, offsets, NOT_SPACE, False, counter.hasher)
        tokens = counter.counts_of(w.hashes, w.data, w.starts, w.ends) if len(w.hashes) else \
            np.zeros(0, np.int64)
        total = np.append(0, np.cumsum(tokens))
        return {"doc_id": part.column("doc_id"), "n_pretokens": w.counts(),
                "n_tokens": total[w.first[1:]] - total[w.first[:-1]]}

    return scan_texts(docs.select("doc_id", "text"), work, fields(
        "doc_id long, n_pretokens long, n_tokens long"))
