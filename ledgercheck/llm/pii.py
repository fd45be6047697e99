"""Personal data by base patterns and a skip-chain conditional random field.

Base spans follow fixed patterns.  The field labels the tokens that hold a digit or an `@` with
one of O, email, ip, card, phone; all other tokens are O by definition and drop out of the graph.
Neighbouring tokens share a chain potential; repeated tokens and tokens that end in the same
digits, however far apart, share a skip potential.  Sum-product messages run over the loopy graph
of each document.  Tokens of base spans are observed; other tokens whose belief in one kind
reaches MIN_BELIEF, and that a skip or chain edge connects to that kind, become added spans.
Base spans always stay.

Groups of equal tokens are linked in order of occurrence, each to the next; an unobserved one is
also linked to the nearest observed ones of its group before and after it, so that evidence does
not fade with the number of repeats.  A token that occurs n times has fewer than 3n links.  What
base patterns tell is fixed: no message changes it.  Messages run in each connected part of a
document until none changes by SETTLED, whatever its length; loopy messages need not settle, so a
part of n tokens that still swings ends after SWINGS + 4n rounds, twice what damped evidence takes
over its longest path.

Node weights (multinomial logistic regression) and edge potentials (pointwise mutual information
of the labels at both ends) are fitted on at most SAMPLE_ROWS texts of at most SAMPLE_CHARS
characters, the first by the hash of their text, labelled by the base patterns.  Everything else
covers whole texts of all rows.

Defined results: null text has no spans; positions are code points, the end exclusive; spans of
different kinds may overlap; rows with equal ids are handled each by itself; other columns are
passed through.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgercheck.llm.common import (fields, fit_in_task, packed, sample_by_hash, scan_texts,
                                    sized_broadcast, string_buffers, unpacked)
from ledgercheck.llm.tokens import NOT_SPACE, Hasher, words

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0 is O
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 20000
DIMENSIONS = 4096
MIN_BELIEF = 0.9
SETTLED = 1e-4
SWINGS = 100
OBSERVED = 30.0
MODEL_BYTES = 4 << 20

# fixed values: the base patterns; possessive where nothing could follow a shorter match
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
EDGE_MARKS = ".,;:!?()[]<>{}\"'"


def luhn(digits: str) -> bool:
    total = 0
    for i, char in enumerate(reversed(digits)):
        d = ord(char) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start; leftmost non-overlapping matches per kind."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        # the pattern's leftmost start before this @ is the start of the run of local characters
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((0, start, found.end()))
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)
    for m in IP.finditer(text):
        # long parts are above 255 unless they are mostly zeros
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def spans_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_SHAPE = [(re.compile(r"[0-9]{7,}"), "N"), (re.compile(r"[0-9]{4,6}"), "M"),
          (re.compile(r"[0-9]{3}"), "T"), (re.compile(r"[0-9]{1,2}"), "S"),
          (re.compile(r"[^\W\d_]+"), "a")]


def shape(token: str) -> str:
    for pattern, code in _SHAPE:
        token = pattern.sub(code, token)
    return token[:24]


def token_features(token: str, before: str, after: str) -> list[int]:
    names = ("s" + shape(token), "b" + before[-12:].lower(), "B" + shape(before[-24:]),
             "a" + after[:12].lower(), "A" + shape(after[:24]), "l" + str(min(len(token), 30)))
    return [zlib.crc32(n.encode()) % DIMENSIONS for n in names]


def keys_of(token: str) -> list[str]:
    """Tokens with a key in common are repeated or similar."""
    if "@" in token:
        return ["@" + token.lower()]
    digits = "".join(c for c in token if "0" <= c <= "9")
    if len(digits) < 4:
        return []
    return ["=" + digits] + (["~" + digits[-7:]] if len(digits) > 7 else ["~" + digits] * (len(digits) == 7))


def barred(token: str) -> int:
    """The label a token can't have: a card number that fails its check, an address beyond 255."""
    digits = "".join(c for c in token if "0" <= c <= "9")
    if len(digits) >= 16 and not (len(digits) <= 19 and luhn(digits)):
        return 3
    if (m := IP.search(token)) and any(int(x[-4:]) > 255 for x in m[0].split(".")):
        return 2
    return 0


class Graph:
    """Candidate tokens of a few texts: nodes, chain edges, skip edges to the next equal token and
    far ones to the nearest observed."""

    def __init__(self) -> None:
        self.row, self.start, self.end, self.label = [], [], [], []
        self.barred, self.features, self.chain, self.skip, self.far = [], [], [], [], []

    def add(self, row: int, text: str, cuts: list[tuple[int, int]], spans) -> None:
        """`cuts`: whitespace-separated candidates as code points, in order."""
        bounds = sorted((a, b, k) for k, a, b in spans)
        last, anchor, waiting, at, previous_end = {}, {}, {}, 0, -2
        for lo, hi in cuts:
            before = text[max(0, lo - 24):lo].rsplit(None, 1)[-1:] or [""]
            after = text[hi:hi + 24].split(None, 1)[:1] or [""]
            while lo < hi and text[lo] in EDGE_MARKS and text[lo] != "(":
                lo += 1
            while hi > lo and text[hi - 1] in EDGE_MARKS and text[hi - 1] != ")":
                hi -= 1
            if lo == hi:
                continue
            while at < len(bounds) and bounds[at][1] <= lo:
                at += 1
            label, i = 0, at
            while i < len(bounds) and bounds[i][0] < hi:
                if bounds[i][1] > lo:
                    label = bounds[i][2] + 1
                    break
                i += 1
            node, token = len(self.row), text[lo:hi] if hi - lo <= 400 else text[lo:lo + 400]
            self.row.append(row)
            self.start.append(lo)
            self.end.append(hi)
            self.label.append(label)
            self.barred.append(0 if label else barred(token))
            self.features.append(token_features(token, before[0], after[0]))
            if previous_end >= 0 and lo - previous_end <= 2:
                self.chain.append((node - 1, node))
            previous_end = hi
            for key in keys_of(text[lo:hi]):
                before = last.get(key)
                if before is not None:
                    self.skip.append((before, node))
                if label:
                    self.far += [(i, node) for i in waiting.pop(key, []) if i != before]
                    anchor[key] = node
                else:
                    waiting.setdefault(key, []).append(node)
                    if key in anchor and anchor[key] != before:
                        self.far.append((anchor[key], node))
                last[key] = node


def graph_of(texts: list, spans: list) -> Graph:
    """The graph of some texts; candidates are found on bytes."""
    out = Graph()
    data, offsets = string_buffers(pa.array(texts, pa.string()))
    marked = (data == 64) | ((data >= 48) & (data <= 57))
    if not marked.any():
        return out
    w = words(data, offsets, NOT_SPACE, False, Hasher())
    seen = np.concatenate([[0], np.cumsum(marked)])
    chosen = np.flatnonzero(seen[w.ends] > seen[w.starts])
    place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before a byte
    rows = np.searchsorted(w.first, chosen, side="right") - 1
    lows = place[w.starts[chosen]] - place[offsets[rows]]
    highs = place[w.ends[chosen]] - place[offsets[rows]]
    cuts: dict[int, list] = {}
    for row, lo, hi in zip(rows.tolist(), lows.tolist(), highs.tolist()):
        cuts.setdefault(row, []).append((lo, hi))
    for row, own in cuts.items():
        out.add(row, texts[row], own, spans[row])
    return out


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """Node weights and edge potentials from the base labels of a bounded sample."""
    short = docs.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS))
    return fit_in_task(sample_by_hash(short.select("text"), "text", rows), _fit)


def _fit(rows: list[dict]) -> dict:
    texts = sorted(r["text"] for r in rows)
    graph = graph_of(texts, [base_spans(t) for t in texts])
    label = np.array(graph.label, int)
    weights = np.zeros((DIMENSIONS, LABELS))
    if len(label):
        at = np.array(graph.features)
        target = np.eye(LABELS)[label]
        look, momentum = weights.copy(), 1.0
        for _ in range(200):  # accelerated descent on the logistic loss
            score = look[at].sum(1)
            share = np.exp(score - score.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            pull = (share - target) / len(label)
            gradient = np.stack([np.bincount(
                at.ravel(), np.repeat(pull[:, k], at.shape[1]), DIMENSIONS)
                for k in range(LABELS)], 1) + 1e-6 * look
            new = look - gradient / 3
            following = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
            look = new + (momentum - 1) / following * (new - weights)
            weights, momentum = new, following
    return {"node": weights, "chain": _potential(graph.chain, label),
            "skip": _potential(graph.skip, label)}


def _potential(edges: list, label: np.ndarray) -> np.ndarray:
    """Log of how much more often two labels meet than by chance; the same in both directions."""
    joint = np.eye(LABELS) * 2 + 0.5
    if edges:
        u, v = np.array(edges).T
        np.add.at(joint, (label[u], label[v]), 1)
    joint = joint + joint.T
    joint /= joint.sum()
    alone = joint.sum(1)
    return np.clip(np.log(joint / np.outer(alone, alone)), -4, 4)


def parts_of(n: int, edges: np.ndarray) -> np.ndarray:
    """The least node of the connected part of every node."""
    part = np.arange(n)
    while True:
        least = part.copy()
        np.minimum.at(least, edges[:, 0], part[edges[:, 1]])
        np.minimum.at(least, edges[:, 1], part[edges[:, 0]])
        least = least[least]
        if (least == part).all():
            return part
        part = least


def beliefs(graph: Graph, model: dict) -> np.ndarray:
    """Label probabilities of every node after loopy sum-product messages."""
    n = len(graph.row)
    node = model["node"][np.array(graph.features)].sum(1)
    node -= node.max(1, keepdims=True)
    label = np.array(graph.label)
    node[label > 0] = -OBSERVED
    node[label > 0, label[label > 0]] = 0
    out = np.flatnonzero(graph.barred)
    node[out, np.array(graph.barred)[out]] -= OBSERVED
    total = node
    edges = np.array(graph.chain + graph.skip + graph.far, int).reshape(-1, 2)
    if len(edges):
        u, v = edges.T
        table = np.stack([model["chain"]] * len(graph.chain)
                         + [model["skip"]] * (len(graph.skip) + len(graph.far)))
        source, target = np.concatenate([u, v]), np.concatenate([v, u])
        table = np.concatenate([table, table])
        back = np.concatenate([np.arange(len(u)) + len(u), np.arange(len(u))])
        message = np.zeros((len(source), LABELS))
        # parts that only observed tokens connect have nothing to tell each other
        part = parts_of(n, edges[(label[u] == 0) & (label[v] == 0)])
        limit = 4 * np.bincount(part, minlength=n) + SWINGS
        live, turn, known = np.flatnonzero(label[target] == 0), 0, -1
        while len(live):
            if len(live) != known:  # edges of settled parts are gone
                known, own, at, of = len(live), part[target[live]], source[live], table[live]
                ends, into = np.unique(target[live], return_inverse=True)
                place = np.full(n, len(ends))  # nothing reaches observed ones
                place[ends] = np.arange(len(ends))
            now, turn = message[live], turn + 1
            gathered = np.stack([np.bincount(into, now[:, k], len(ends) + 1)
                                 for k in range(LABELS)], 1)
            leaving = (node[at] + gathered[place[at]] - message[back[live]])[:, :, None] + of
            top = leaving.max(1, keepdims=True)
            new = top[:, 0] + np.log(np.exp(leaving - top).sum(1))
            new -= new.max(1, keepdims=True)
            message[live] = 0.5 * now + 0.5 * new
            moving = np.zeros(n, bool)
            moving[own[np.abs(new - now).max(1) > SETTLED]] = True
            live = live[moving[own] & (turn < limit[own])]
        total = node + np.stack([np.bincount(target, message[:, k], n) for k in range(LABELS)], 1)
    total = np.exp(total - total.max(1, keepdims=True))
    return total / total.sum(1, keepdims=True)


def added_spans(texts: list, spans: list, model: dict) -> list[list]:
    """Spans that the field adds to the base spans of each text."""
    out: list[list] = [[] for _ in texts]
    graph = graph_of(texts, spans)
    if not graph.row:
        return out
    p = beliefs(graph, model)
    best = p.argmax(1)
    label = np.array(graph.label)
    # a label needs support: an observed token of that kind reached over edges of that label
    edges = np.array(graph.chain + graph.skip + graph.far, int).reshape(-1, 2)
    part = parts_of(len(best), edges[best[edges[:, 0]] == best[edges[:, 1]]])
    supported = np.bincount(part, label > 0, len(best))[part] > 0
    chosen = np.flatnonzero((label == 0) & (best > 0) & supported & (p.max(1) >= MIN_BELIEF))
    for i in chosen.tolist():
        own, kind = out[graph.row[i]], int(best[i]) - 1
        if own and own[-1][0] == kind and own[-1][3] == i - 1 and graph.start[i] - own[-1][2] <= 2:
            own[-1] = (kind, own[-1][1], graph.end[i], i)
        else:
            own.append((kind, graph.start[i], graph.end[i], i))
    return [[(k, a, b) for k, a, b, _ in own] for own in out]


def _all_spans(part: pa.RecordBatch, model: dict):
    texts = [t or "" for t in part.column("text").to_pylist()]
    base = [base_spans(t) for t in texts]
    return texts, base, added_spans(texts, base, model)


def _shared(docs: DataFrame, model: dict):
    return sized_broadcast(docs.sparkSession, model, sum(v.nbytes for v in model.values()),
                           MODEL_BYTES, "field weights")


def find_pii(docs: DataFrame, model: dict) -> DataFrame:
    """`row` (all columns but text), counts and digest of the base spans, and all spans."""
    shared = _shared(docs, model)

    def work(part: pa.RecordBatch) -> dict:
        _, base, added = _all_spans(part, shared.value)
        count = [[sum(s[0] == k for s in own) for own in base] for k in range(len(KINDS))]
        return {"row": part.column("row"), "n_email": count[0], "n_ip": count[1],
                "n_card": count[2], "n_phone": count[3],
                "base_sha256": [hashlib.sha256(spans_text(x).encode()).hexdigest() for x in base],
                "spans": [spans_text(sorted({*x, *y})) for x, y in zip(base, added)],
                "n_added": [len(x) for x in added]}

    rows = packed(docs)
    return scan_texts(rows, work, fields(
        "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
        "n_added long", rows.schema["row"]))


def redact(docs: DataFrame, model: dict) -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; overlapping spans become one,
    named after the first.  Texts without spans stay as they are."""
    shared = _shared(docs, model)

    def work(part: pa.RecordBatch) -> dict:
        texts, base, added = _all_spans(part, shared.value)
        out = part.column("text").to_pylist()
        for i, text in enumerate(texts):
            pieces, done, end = [], 0, -1
            for a, b, k in sorted((a, b, k) for k, a, b in [*base[i], *added[i]]):
                if a >= end:
                    pieces += [text[max(done, 0):a], f"[{KINDS[k].upper()}]"]
                    done = end = b
                else:
                    done = end = max(end, b)
            if pieces:
                out[i] = "".join([*pieces, text[done:]])
        return {"row": part.column("row"), "text": out,
                "cut": [bool(x or y) for x, y in zip(base, added)]}

    rows = packed(docs)
    done = scan_texts(rows, work, fields("text string, cut boolean", rows.schema["row"]))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("cut"), F.length("text").cast("long")).otherwise(
            F.col("row.n_chars"))
    return unpacked(done, docs.columns, **changed)
