"""Removal of repeated passages: FM-indexes per shard, matched by backward search.

A window is SIZE consecutive words of one document.  A word goes when a window over it also starts
earlier: in a document of smaller id, or earlier in the same document.

1. Every window has an anchor, its least run of GRAM words by hash.  Neighbouring windows with one
   anchor form a segment, about 26 words.  Equal windows have equal anchors, so repeats are found
   among the segments of one anchor.  Anchors travel packed, thousands in a shuffle row; segments
   whose anchor occurs once in the corpus go no further.
2. Equal segments are one text with its first place.  These texts are dealt to shards by anchor;
   each shard of about SHARD_SYMBOLS words is a compressed FM-index (see fmindex).  All its segments
   are streamed through it; matching statistics of SIZE words give, for every window, the first
   place it starts at in the corpus.
3. Every occurrence of a segment is held against the reported places; the intervals are gathered
   per document, whose words are then cut.

An anchor with more than MAX_SEGMENTS different segments (near copies in great number) is dealt
anew by window: each of its windows is a segment of its own, keyed by its own hash.

Defined results: null text has no words; texts of fewer than SIZE words lose nothing.  A null id
counts as the smallest.  Rows that agree in id and text get the same result, and neither repeats
the other; rows that agree in id alone are told apart by their text, their equal starts are not
earlier than each other.  Other columns are passed through.  Words, segments and anchors are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ledgercheck.llm.common import (bitmap_of, fields, in_bitmap, scan_texts, settled, slices,
                                    string_buffers, to_batch)
from ledgercheck.llm.fmindex import FMIndex
from ledgercheck.llm.tokens import NOT_SPACE, Hasher, Words, mix, window_starts, words

SIZE = 20
GRAM = 8
SHARD_SYMBOLS = 300_000
MAX_SEGMENTS = 4096
BUCKET_SEGMENTS = 300_000
MAX_BUCKETS = 1 << 14
FLUSH = 300_000
LOWEST = -(1 << 63)  # stands for a null id


def ids_of(part: pa.RecordBatch) -> np.ndarray:
    return np.array([LOWEST if d is None else d for d in part.column("doc_id").to_pylist()],
                    np.int64)


def prints(w: Words) -> np.ndarray:
    """A hash of each row's words in order; it tells rows of one id apart."""
    hasher = Hasher()
    return hasher.runs(w.hashes, w.first[:-1], w.first[1:]).view(np.int64)


def segments(w: Words, hasher: Hasher):
    """(first word, number of windows, anchor) of every segment."""
    at = window_starts(w, SIZE)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, np.zeros(0, np.uint64)
    # hashes of all runs of GRAM words, also where they cross rows: windows never do
    n = len(w.hashes) - GRAM + 1
    grams = hasher.runs(w.hashes, np.arange(n), np.arange(n) + GRAM)
    reach = SIZE - GRAM + 1
    best, place = grams[at], at.copy()
    for step in range(1, reach):  # leftmost least
        other = grams[at + step]
        less = other < best
        best = np.where(less, other, best)
        place = np.where(less, at + step, place)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), best[first]


def anchored(docs: DataFrame, buckets: int) -> DataFrame:
    """(anchor, content, doc_id, print, start, n) of the segments whose anchor repeats."""
    blobs = fields("bucket int, anchors binary, contents binary, at binary, starts binary, "
                   "counts binary, ids binary, prints binary")
    blob_types = to_arrow_schema(blobs)

    def pack(parts: list) -> pa.RecordBatch:
        anchors, contents, at, starts, counts = (np.concatenate([p[i] for p in parts])
                                                 for i in range(5))
        ids, marks = (np.concatenate([p[i] for p in parts]) for i in (5, 6))
        bucket = (mix(anchors) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = {f.name: [] for f in blob_types}
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            mine = order[cuts[b]:cuts[b + 1]]
            used, place = np.unique(at[mine], return_inverse=True)
            for name, value in (
                    ("bucket", b), ("anchors", anchors[mine].tobytes()),
                    ("contents", contents[mine].tobytes()),
                    ("at", place.astype(np.uint32).tobytes()),
                    ("starts", starts[mine].astype(np.int32).tobytes()),
                    ("counts", counts[mine].astype(np.uint8).tobytes()),
                    ("ids", ids[used].tobytes()), ("prints", marks[used].tobytes())):
                out[name].append(value)
        return to_batch(out, blob_types)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, parts, n, rows = Hasher(), [], 0, 0
        for part in slices(batches, "text"):
            data, offsets = string_buffers(part.column("text"))
            w = words(data, offsets, NOT_SPACE, False, hasher)
            start, count, anchor = segments(w, hasher)
            row = np.searchsorted(w.first, start, side="right") - 1
            content = hasher.runs(w.hashes, start, start + count + SIZE - 1)
            parts.append((anchor, content, row + rows, start - w.first[row], count, ids_of(part),
                          prints(w)))
            n += len(start)
            rows += part.num_rows
            if n > FLUSH:
                yield pack(parts)
                parts, n, rows = [], 0, 0
        if parts:
            yield pack(parts)

    schema = fields("anchor long, content long, doc_id long, print long, start int, n int")
    types = to_arrow_schema(schema)

    class Bucket:
        """The different anchors so far; the first segment of each waits for a second."""

        def __init__(self) -> None:
            self.first = [np.zeros(0, k) for k in (np.uint64, np.int64, np.int64, np.int64,
                                                   np.int32, np.uint8)]
            self.out = np.zeros(0, bool)  # whether the first has been given out
            self.waiting, self.n = [], 0

        def flush(self) -> pa.RecordBatch | None:
            if not self.waiting:
                return None
            rows = [np.concatenate(x) for x in zip(*self.waiting)]
            self.waiting, self.n = [], 0
            unique, at = np.unique(rows[0], return_index=True)
            known = self.first[0]
            if len(known):
                place = np.searchsorted(known, unique).clip(0, len(known) - 1)
                new = known[place] != unique
            else:
                new = np.ones(len(unique), bool)
            merged = [np.concatenate([old, r[at[new]]]) for old, r in zip(self.first, rows)]
            out = np.concatenate([self.out, np.zeros(int(new.sum()), bool)])
            order = np.argsort(merged[0], kind="stable")
            self.first, self.out = [m[order] for m in merged], out[order]
            rest = np.ones(len(rows[0]), bool)
            rest[at[new]] = False
            again = np.unique(np.searchsorted(self.first[0], rows[0][rest]))
            fresh = again[~self.out[again]]
            self.out[fresh] = True
            given = [np.concatenate([f[fresh], r[rest]]) for f, r in zip(self.first, rows)]
            if not len(given[0]):
                return None
            return to_batch(dict(zip(types.names, (
                given[0].view(np.int64), *given[1:5], given[5].astype(np.int32)))), types)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, Bucket()
        kinds = (np.uint64, np.int64, np.uint32, np.int32, np.uint8, np.int64, np.int64)
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in range(1, 8))):
                if row[0] != now or state.n > FLUSH:
                    out = state.flush()
                    if out is not None:
                        yield out
                    if row[0] != now:
                        now, state = row[0], Bucket()
                anchor, content, at, start, count, ids, marks = (
                    np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row[1:], kinds))
                state.waiting.append((anchor, content, ids[at], marks[at], start, count))
                state.n += len(anchor)
        out = state.flush()
        if out is not None:
            yield out

    return docs.mapInArrow(emit, blobs).repartition("bucket").sortWithinPartitions("bucket") \
        .mapInArrow(gather, schema)


def with_texts(docs: DataFrame, wanted: DataFrame, by_window: bool) -> DataFrame:
    """Segments `wanted` (anchor, content, doc_id, print, start, n) with their words joined by
    a space; or, by window, each window of them as a segment (anchor and content: its hash)."""
    lookup = bitmap_of(wanted, F.col("doc_id"))
    hasher = Hasher()

    def only(part: pa.RecordBatch) -> dict:
        sub = part.take(pa.array(np.flatnonzero(in_bitmap(lookup.value, ids_of(part)))))
        data, offsets = string_buffers(sub.column("text"))
        return {"doc_id": ids_of(sub), "text": sub.column("text"),
                "print": prints(words(data, offsets, NOT_SPACE, False, hasher))}

    def cut(part: pa.RecordBatch) -> dict:
        out = {f.name: [] for f in schema}
        data, offsets = string_buffers(part.column("text"))
        w = words(data, offsets, NOT_SPACE, False, hasher if by_window else None)
        for row, (doc, mark, own) in enumerate(zip(
                *(part.column(c).to_pylist() for c in ("doc_id", "print", "own")))):
            base = int(w.first[row])
            for x in own:
                start, n = x["start"], x["n"]
                if by_window:
                    at = np.arange(base + start, base + start + n)
                    codes = hasher.runs(w.hashes, at, at + SIZE).view(np.int64).tolist()
                    found = [(c, c, start + i, 1) for i, c in enumerate(codes)]
                else:
                    found = [(x["anchor"], x["content"], start, n)]
                for anchor, content, start, n in found:
                    out["anchor"].append(anchor)
                    out["content"].append(content)
                    out["doc_id"].append(doc)
                    out["print"].append(mark)
                    out["start"].append(start)
                    out["n"].append(n)
                    out["words"].append(None if by_window
                                        else w.joined(base + start, n + SIZE - 1))
        return out

    schema = fields("anchor long, content long, doc_id long, print long, start int, n int, "
                    "words binary")
    texts = scan_texts(docs, only, fields("doc_id long, print long, text string"))
    # equal rows give one text
    own = wanted.groupBy("doc_id", "print").agg(F.collect_list(
        F.struct("anchor", "content", "start", "n")).alias("own"))
    joined = texts.join(own, ["doc_id", "print"]).dropDuplicates(["doc_id", "print"]) \
        .select("doc_id", "print", "own", "text")
    return scan_texts(joined, cut, schema)


def firsts(found: DataFrame) -> DataFrame:
    """The first place of every different segment."""
    least = found.groupBy("anchor", "content").agg(
        F.min(F.struct("doc_id", "start", "print")).alias("f"), F.first("n").alias("n"))
    return least.select("anchor", "content", "f.doc_id", "f.print", "f.start", "n")


def reports(texts: DataFrame) -> DataFrame:
    """(content, doc_id, start, mask): of each different segment its first place and which of
    its windows start earlier in the corpus, from the FM-index of its shard."""
    schema = fields("content long, doc_id long, start int, mask long")
    types = to_arrow_schema(schema)

    def shard(rows: list) -> pa.RecordBatch:
        hasher = Hasher()
        contents, ids, starts, blobs = zip(*rows)
        ids, starts = np.array(ids, np.int64), np.array(starts, np.int64)
        raw = b"".join(blobs)
        offsets = np.append(0, np.cumsum([len(b) for b in blobs]))
        w = words(np.frombuffer(raw, np.uint8), offsets, NOT_SPACE, False, hasher)
        alphabet, symbols = np.unique(w.hashes, return_inverse=True)
        counts = w.counts()
        text = np.zeros(len(symbols) + len(rows), np.int64)
        begin = w.first[:-1] + np.arange(len(rows))
        owner = np.repeat(np.arange(len(rows)), counts)
        text[np.arange(len(symbols)) + owner] = symbols + 1
        # order numbers: by document, then by place in it
        known = np.unique(ids, return_inverse=True)[1]
        order = np.full(len(text), np.iinfo(np.int64).max)
        within = np.arange(len(symbols)) - w.first[owner]
        order[np.arange(len(symbols)) + owner] = (known[owner] << 32) | (starts[owner] + within)
        index = FMIndex(text, order, len(alphabet) + 1, SIZE)
        segment, at, least = index.statistics(text, begin, begin + counts)
        earlier = least < order[at]
        mask = np.zeros(len(rows), np.int64)
        np.bitwise_or.at(mask, segment[earlier],
                         np.int64(1) << (at - begin[segment])[earlier])
        return to_batch({"content": list(contents), "doc_id": ids, "start": starts.astype(np.int32),
                         "mask": mask}, types)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, symbols, last = [], 0, None
        for batch in batches:
            for anchor, *row in zip(*(batch.column(c).to_pylist() for c in (
                    "anchor", "content", "doc_id", "start", "words"))):
                if anchor != last and symbols >= SHARD_SYMBOLS:
                    yield shard(rows)
                    rows, symbols = [], 0
                last = anchor
                rows.append(row)
                symbols += SIZE + 6
        if rows:
            yield shard(rows)

    return texts.select("anchor", "content", "doc_id", "start", "words").repartition("anchor") \
        .sortWithinPartitions("anchor").mapInArrow(stream, schema)


def covered(docs: DataFrame, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """(doc_id, print, start, mask): windows that also start earlier, as bits after `start`."""
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(MAX_BUCKETS, max(8, volume // 40 // BUCKET_SEGMENTS)))
    found = settled(anchored(docs, buckets), "anchored")
    first = settled(firsts(found), "firsts")
    busy = first.groupBy("anchor").count().where(F.col("count") > max_segments).select("anchor")
    busy = settled(busy, "busy")
    texts = with_texts(docs, first.join(busy, "anchor", "left_anti"), False)
    if not busy.isEmpty():
        # near copies in great number: every window by its own hash, equal ones first made one
        split = settled(with_texts(docs, found.join(busy, "anchor"), True).drop("words"), "split")
        found = found.join(busy, "anchor", "left_anti").select(split.columns).union(split)
        texts = texts.union(with_texts(docs, firsts(split), False))
    report = settled(reports(texts), "reports")
    at = report.select("content", F.col("doc_id").alias("first_id"),
                       F.col("start").alias("first_start"), "mask")
    every = F.expr("shiftleft(1L, n) - 1")
    is_first = (F.col("doc_id") == F.col("first_id")) & (F.col("start") == F.col("first_start"))
    return found.join(at, "content").select(
        "doc_id", "print", "start", F.when(is_first, F.col("mask")).otherwise(every).alias("mask")
    ).where("mask <> 0")


def remove_repeats(docs: DataFrame, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words of every row that stay, joined by a space.

    `kept` is null where no word goes; `kept_sha256` is always there."""
    hasher = Hasher()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = settled(covered(docs, max_segments).distinct().groupBy("doc_id", "print").agg(
        F.collect_list(F.struct("start", "mask")).alias("own")), "cuts")
    lookup = bitmap_of(cuts, F.col("doc_id"))

    def every(part: pa.RecordBatch) -> dict:
        ids = ids_of(part)
        maybe = in_bitmap(lookup.value, ids)
        # only rows that may lose words need their print
        data, offsets = string_buffers(part.column("text").filter(pa.array(maybe)))
        marks = np.zeros(len(ids), np.int64)
        marks[maybe] = prints(words(data, offsets, NOT_SPACE, False, hasher))
        counts, sums, texts = [], [], []
        for text, m in zip(part.column("text").to_pylist(), maybe.tolist()):
            all_words = (text or "").encode().split()
            counts.append(len(all_words))
            sums.append(None if m else hashlib.sha256(b" ".join(all_words)).hexdigest())
            texts.append(text if m else None)
        return {"id": part.column("doc_id"), "doc_id": ids, "print": marks, "n_words": counts,
                "kept_sha256": sums, "text": texts}

    def cut(part: pa.RecordBatch) -> dict:
        n_removed, kept, sums = [], [], []
        for text, own, known in zip(*(part.column(c).to_pylist() for c in (
                "text", "own", "kept_sha256"))):
            if known is not None:
                n_removed.append(0)
                kept.append(None)
                sums.append(known)
                continue
            all_words = (text or "").encode().split()
            goes = np.zeros(len(all_words) + 1, np.int64)
            for x in own or ():
                mask, i = x["mask"], x["start"]
                while mask:
                    if mask & 1:
                        goes[i] += 1
                        goes[i + SIZE] -= 1
                    mask, i = mask >> 1, i + 1
            gone = np.cumsum(goes[:-1]) > 0
            left = b" ".join([x for x, g in zip(all_words, gone.tolist()) if not g])
            n_removed.append(int(gone.sum()))
            kept.append(left.decode() if own else None)
            sums.append(hashlib.sha256(left).hexdigest())
        return {"doc_id": part.column("id"), "n_words": part.column("n_words"),
                "n_removed": n_removed, "kept_sha256": sums, "kept": kept}

    rows = scan_texts(docs, every, fields(
        "id long, doc_id long, print long, n_words long, kept_sha256 string, text string"))
    return scan_texts(rows.join(cuts, ["doc_id", "print"], "left").drop("doc_id", "print"), cut,
                      fields("doc_id long, n_words long, n_removed long, kept_sha256 string, "
                             "kept string"))
