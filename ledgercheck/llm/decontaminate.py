"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over all documents.

Every run of `size` benchmark words (an item of fewer words is one run) goes into a hash set
that is broadcast.  Documents are scanned once; runs whose hash is in the set are compared word
by word before they count.  The set is broadcast in blocks of at most MAX_WINDOWS rows: one
block for any usual benchmark; beyond it the documents pass the blocks one after the other, and
their hits are kept in the shared folder in between, so no benchmark is too large.

Defined results: null or empty text has no words and no hits.  Rows with equal ids are judged
each by itself.  Null item ids are hit but neither counted nor listed.  Two items with one id are
one item.  Other columns of either table are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgercheck.llm.common import fields, packed, scan_texts, settled, string_buffers, unpacked
from ledgercheck.llm.tokens import ALNUM, Hasher, windows, words

SIZE = 10
MAX_WINDOWS = 1 << 18  # rows (run, item) in one broadcast block, about 40 MB

HITS = "first array<int>, length array<int>, items array<string>"


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct (hash, words, n, item_id) of the benchmark."""
    def work(part: pa.RecordBatch) -> dict:
        hasher = Hasher()
        data, offsets = string_buffers(part.column("text"))
        w = words(data, offsets, ALNUM, True, hasher)
        ids = part.column("item_id").to_pylist()
        out = {"hash": [], "words": [], "n": [], "item_id": []}
        at, hashes = windows(w, size, hasher)
        rows = np.searchsorted(w.first, at, side="right") - 1
        found = list(zip(at.tolist(), [size] * len(at), hashes.view(np.int64).tolist(), rows.tolist()))
        for row, n in enumerate(w.counts().tolist()):
            if 0 < n < size:
                start = int(w.first[row])
                one = hasher.runs(w.hashes, np.array([start]), np.array([start + n]))
                found.append((start, n, int(one.view(np.int64)[0]), row))
        for start, n, code, row in found:
            out["hash"].append(code)
            out["words"].append(w.joined(start, n))
            out["n"].append(n)
            out["item_id"].append(ids[row])
        return out

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return scan_texts(
        items, work, fields("hash long, words binary, n int, item_id string")).distinct()


def _index(rows: list) -> dict:
    """Sorted hashes by run length, with the words and items of each."""
    by_length: dict[int, dict] = {}
    for code, text, n, item in rows:
        entry = by_length.setdefault(n, {}).setdefault(bytes(text), (code, set()))
        if item is not None:
            entry[1].add(item)
    index = {}
    for n, entries in by_length.items():
        hashes = np.array([code for code, _ in entries.values()], np.int64).view(np.uint64)
        order = np.argsort(hashes, kind="stable")
        texts, items = list(entries), [sorted(i) for _, i in entries.values()]
        seen = np.zeros(1 << 20, bool)  # most runs are ruled out by 20 bits of their hash
        seen[hashes & np.uint64((1 << 20) - 1)] = True
        index[n] = (seen, hashes[order], [texts[i] for i in order], [items[i] for i in order])
    return index


def _hits(part: pa.RecordBatch, index: dict, hasher: Hasher):
    """Words of the rows, and (first word, length, item ids) of every verified run."""
    data, offsets = string_buffers(part.column("text"))
    w = words(data, offsets, ALNUM, True, hasher)
    found = []
    for n, (seen, hashes, texts, items) in index.items():
        at, codes = windows(w, n, hasher)
        maybe = np.flatnonzero(seen[codes & np.uint64((1 << 20) - 1)])
        places = np.searchsorted(hashes, codes[maybe])
        for i, place in zip(maybe.tolist(), places.tolist()):
            code, start = codes[i], int(at[i])
            while place < len(hashes) and hashes[place] == code:
                if w.joined(start, n) == texts[place]:
                    found.append((start, n, items[place]))
                place += 1
    return w, found


def _scan(docs: DataFrame, index, finish=None, ddl: str = "") -> DataFrame:
    """`docs` (row, text, hits so far) with the hits of one block added; after the last block
    `finish` turns rows, words and hits into the columns of `ddl`."""
    hasher = Hasher()

    def work(part: pa.RecordBatch) -> dict:
        w, found = _hits(part, index.value, hasher)
        first = part.column("first").to_pylist()
        length = part.column("length").to_pylist()
        items = [set(x) for x in part.column("items").to_pylist()]
        rows = np.searchsorted(w.first, [f[0] for f in found], side="right") - 1
        for (start, n, ids), row in zip(found, rows.tolist()):
            first[row].append(start - int(w.first[row]))
            length[row].append(n)
            items[row].update(ids)
        if finish:
            return {"row": part.column("row")} | finish(
                part, w, [merged(a, n) for a, n in zip(first, length)], [sorted(x) for x in items])
        return {"row": part.column("row"), "text": part.column("text"), "first": first,
                "length": length, "items": [sorted(x) for x in items]}

    return scan_texts(docs, work, fields(ddl or f"text string, {HITS}", docs.schema["row"]))


def find_hits(docs: DataFrame, benchmark: DataFrame, finish, ddl: str, size: int = SIZE,
              max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per row of `docs`: `row` (its columns but text) and what `finish` makes of it.

    `finish(part, words, intervals, items)` gets the rows, their words, the hit intervals of
    words and the sorted ids of the items that occur."""
    spark = docs.sparkSession
    runs = settled(benchmark_windows(benchmark, size), "benchmark")
    blocks = max(1, -(-runs.count() // max_windows))
    none = F.array().cast("array<int>")
    out = packed(docs).select("row", "text", none.alias("first"), none.alias("length"),
                              F.array().cast("array<string>").alias("items"))
    for block in range(blocks):
        # about max_windows rows at most, whatever the size of the benchmark
        mine = runs if blocks == 1 else runs.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block)
        index = spark.sparkContext.broadcast(
            _index([tuple(r) for r in mine.select("hash", "words", "n", "item_id").collect()]))
        if block == blocks - 1:
            return _scan(out, index, finish, ddl)
        out = settled(_scan(out, index), "hits")
    raise AssertionError("there is always a last block")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE,
                  max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per document `row` (its columns but text), the number of words, of hit words and of items
    that occur, and the hit intervals of words."""
    def finish(part, w, intervals, items) -> dict:
        n_hit = [sum(b - a for a, b in x) for x in intervals]
        return {"n_words": w.counts(), "n_hit": n_hit, "n_items": [len(x) for x in items],
                "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
                "contaminated": [x > 0 for x in n_hit],
                "hits": [[{"first": a, "end": b} for a, b in x] for x in intervals]}

    return find_hits(docs, benchmark, finish, (
        "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
        "hits array<struct<first: int, end: int>>"), size, max_windows)


def merged(first: list[int], length: list[int]) -> list[tuple[int, int]]:
    """Runs of words as disjoint intervals in order."""
    out: list[list[int]] = []
    for a, n in sorted(zip(first, length)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [tuple(x) for x in out]


def remove_hits(docs: DataFrame, benchmark: DataFrame, size: int = SIZE,
                drop_share: float = 0.5) -> DataFrame:
    """`docs` without benchmark passages: hit words are cut out of the text, from the first
    byte of the first to the last of the last; a document of which at least `drop_share` of
    the words are hit goes.  Documents without hits are kept as they are."""
    def finish(part, w, intervals, items) -> dict:
        texts, keep, cut = part.column("text").to_pylist(), [], []
        for row, runs in enumerate(intervals):
            base, end = int(w.first[row]), int(w.first[row + 1])
            keep.append(not runs or sum(b - a for a, b in runs) < drop_share * (end - base))
            cut.append(bool(runs))
            if runs and keep[-1]:
                raw, out, done = texts[row].encode(), [], 0
                start = int(w.offsets[row])
                for a, b in runs:
                    out.append(raw[done:int(w.starts[base + a]) - start])
                    done = int(w.ends[base + b - 1]) - start
                texts[row] = b"".join([*out, raw[done:]]).decode()
        return {"text": texts, "kept": keep, "cut": cut}

    done = find_hits(docs, benchmark, finish, "text string, kept boolean, cut boolean",
                     size).where("kept")
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("cut"), F.length("text").cast("long")).otherwise(
            F.col("row.n_chars"))
    return unpacked(done, docs.columns, **changed)
