"""Similarity join on word n-grams: a size-aware heavy-light join, and its components.

Two documents link when their sets of distinct 5-word shingles have a Jaccard similarity of at
least 3/4.  Equal sets are one node.  Two ways find the links between different sets:

* Small sets (at most `boundary` shingles) enumerate the subsets of the size a link needs.  Sets
  of s <= t shingles link when they share o(s, t) = ceil(3 (s + t) / 7); each lists its subsets of
  that size under a key of (s, t, subset).  An equal key of a set of s shingles is a link.
* Large sets, and small ones that could link with them, put their rarest shingles into inverted
  lists: a set of s is entered under s - ceil(6 s / 7) + 1 of them and looked up under
  s - ceil(3 s / 4) + 1.  Of two linked sets one of the entries of the smaller is among the look-ups
  of the larger.  Rarity is a count over all documents in a table of CELLS counters; any common
  order is right, so collisions only cost time.

The boundary is chosen by cost from the number of sets of each size.

A list is never paired off.  All its sets are compared with one that is entered (a star); links
are closed to components; lists whose sets are all in one component are done; the others get
further stars, sixteen times as many each round, whose centres are then done.  So every candidate of
every list ends in one component or is compared, and a list of n near copies costs about n
comparisons.

Postings travel packed: hashes and set numbers as arrays per bucket of keys, so that a shuffle
row holds thousands.  A bucket is read as a stream; it keeps one entry per different key.

Pairs are first held against parities of their sets, a few bits per shingle, which rule out most
pairs that do not link and none that does; only the sets of the others are fetched.

Shingles and sets are told apart by 64-bit hashes.

Defined results: null or empty text has no shingles and no links, its component is itself; fewer
than five words are one shingle.  Rows with equal ids and different text are two documents whose
common id is the id of both; null ids come after all others.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ledgercheck.llm.common import (bitmap_of, discard, fields, in_bitmap, packed, scan_texts,
                                    settled, slices, string_buffers, to_batch, unpacked)
from ledgercheck.llm.components import components
from ledgercheck.llm.tokens import NOT_SPACE, Hasher, mix, windows, words

SIZE = 5                 # words in a shingle
SHARE = (3, 4)           # the similarity as a fraction
CELLS = 1 << 22          # counters of shingles
MAX_SMALL = 12           # largest boundary considered
LIST_PART = 2048         # members of one list that meet its centres in one task
VERIFY = 4               # cost of comparing a posting's set, in postings
LOOK_UP = 255            # kind of a posting that is a look-up and no entry
BUCKET_POSTINGS = 500_000
MAX_BUCKETS = 1 << 14
FLUSH = 500_000        # postings a task packs at once
FIRST_CENTRES = 1000     # stars per list in the first further round; then 16 times as many


def needed(s: int, t: int) -> int:
    """Shingles that linked sets of s and t shingles share at least: J / (1 + J) (s + t)."""
    a, b = SHARE
    return -(-a * (s + t) // (a + b))


def fits(s: int, t: int) -> bool:
    """Whether sets of these sizes can link at all."""
    a, b = SHARE
    return min(s, t) * b >= a * max(s, t)


def entries(s: int) -> int:
    """Shingles a set of s is entered under: one is shared with any linked set as large or larger."""
    return s - needed(s, s) + 1


def look_ups(s: int) -> int:
    """Shingles a set of s is looked up under: one is shared with any linked set, entered or not."""
    a, b = SHARE
    return s - (-(-a * s // b)) + 1


def pairs_of_sizes(t: int) -> list[tuple[int, int]]:
    """(s, u), s <= u: the size pairs in which a set of t shingles lists its subsets."""
    a, b = SHARE
    below = [(s, t) for s in range(1, t) if fits(s, t)]
    above = [(t, u) for u in range(t, t * b // a + 1)]
    return below + above


def choose_boundary(sizes: dict[int, int]) -> int:
    """The boundary of least cost, from the number of sets of each size up to 2 MAX_SMALL."""
    def cost(x: int) -> int:
        small = sum(n * sum(comb(t, needed(s, u)) for s, u in pairs_of_sizes(t) if u <= x)
                    for t, n in sizes.items() if t <= x)
        large = sum(n * look_ups(t) * (1 + VERIFY) for t, n in sizes.items()
                    if fits(t, x + 1) or t > x)
        return small + large

    return min(range(1, MAX_SMALL + 1), key=lambda x: (cost(x), x))


def sets_of(part: pa.RecordBatch, hasher: Hasher) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    data, offsets = string_buffers(part.column("text"))
    w = words(data, offsets, NOT_SPACE, True, hasher)
    at, codes = windows(w, SIZE, hasher)
    cuts = np.searchsorted(at, w.first)
    out = []
    for row, n in enumerate(w.counts().tolist()):
        if 0 < n < SIZE:
            start = w.first[row:row + 1]
            out.append(hasher.runs(w.hashes, start, start + n))
        else:
            out.append(np.unique(codes[cuts[row]:cuts[row + 1]]))
    return out


def node_of(own: np.ndarray) -> int | None:
    """A 64-bit name of a set; None for the empty set."""
    if not len(own):
        return None
    total = mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(own))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def marks_of(own: np.ndarray) -> bytes | None:
    """Parities of a set: four bits or more per shingle, each flipped by those it stands for.

    Two sets of s and t shingles that link differ in at most (s + t) / 7 of them, so their
    parities, folded to one length, differ in no more bits."""
    if not len(own):
        return None
    n = mark_bits(len(own))
    odd = np.bincount((own >> np.uint64(20) & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def mark_bits(size: int) -> int:
    return max(256, 4 << (size - 1).bit_length())


def may_link(x: bytes, y: bytes, s: int, t: int) -> bool:
    """False if the parities rule a link out."""
    one, two = (np.frombuffer(v, np.uint8) for v in (x, y))
    while len(one) > len(two):  # the high bit of the number goes: the halves meet
        one = one[:len(one) // 2] ^ one[len(one) // 2:]
    while len(two) > len(one):
        two = two[:len(two) // 2] ^ two[len(two) // 2:]
    a, b = SHARE
    return int(np.bitwise_count(one ^ two).sum()) * (a + b) <= (b - a) * (s + t)


def sizes_and_counts(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, node, marks) of every row, and a level of rarity per counter."""
    schema = fields("doc_id long, n_shingles long, node long, marks binary, chunk int, "
                    "counts binary")
    types, chunks = to_arrow_schema(schema), 64

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, cells, waiting, n = Hasher(), np.zeros(CELLS, np.uint32), [], 0
        for part in slices(batches, "text"):
            sets = sets_of(part, hasher)
            waiting.append(np.concatenate(sets) & np.uint64(CELLS - 1))
            n += len(waiting[-1])
            if n > FLUSH:
                cells += np.bincount(np.concatenate(waiting).astype(np.int64),
                                     minlength=CELLS).astype(np.uint32)
                waiting, n = [], 0
            none = [None] * len(sets)
            yield to_batch({"doc_id": part.column("doc_id"), "n_shingles": [len(x) for x in sets],
                            "node": [node_of(x) for x in sets],
                            "marks": [marks_of(x) for x in sets], "chunk": none, "counts": none},
                           types)
        if waiting:
            cells += np.bincount(np.concatenate(waiting).astype(np.int64),
                                 minlength=CELLS).astype(np.uint32)
        if cells.any():
            small = np.minimum(cells, 65535).astype(np.uint16).reshape(chunks, -1)
            none = [None] * chunks
            yield to_batch({"doc_id": none, "n_shingles": none, "node": none, "marks": none,
                            "chunk": list(range(chunks)), "counts": [x.tobytes() for x in small]},
                           types)

    found = settled(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, schema),
                    "sets")
    total = fields("chunk int, counts binary")
    total_types = to_arrow_schema(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(blob.as_buffer(), np.uint16)
                sums[chunk] = sums.get(chunk, 0) + counts.astype(np.int64)
        if sums:
            yield to_batch({"chunk": list(sums), "counts": [
                np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes() for x in sums.values()]},
                total_types)

    counts = found.where(F.col("chunk").isNotNull()).select("chunk", "counts")
    cells = np.zeros(CELLS, np.int64)
    for row in counts.repartition(16, "chunk").mapInArrow(add, total).toLocalIterator():  # 16 MB
        at = row["chunk"] * (CELLS // chunks)
        cells[at:at + CELLS // chunks] = np.frombuffer(row["counts"], np.uint32)
    # counters near the mean say nothing; beyond it, the power of two
    scale = np.log2(np.maximum(cells / (2 * cells.mean() + 8), 1))
    return (found.where(F.col("chunk").isNull()).select("doc_id", "n_shingles", "node", "marks"),
            np.ceil(2 * scale).clip(0, 255).astype(np.uint8))


def postings_of(own: np.ndarray, level: np.ndarray, boundary: int):
    """Keys of one set, and the kind of each: the smaller size for a subset key, 0 for an entry,
    LOOK_UP for a look-up."""
    t, keys, kinds = len(own), [], []
    if t > boundary or fits(t, boundary + 1):
        order = (level[own & np.uint64(CELLS - 1)].astype(np.uint64) << np.uint64(56)) \
            | (own >> np.uint64(8))
        keys.append(own[np.argsort(order, kind="stable")[:look_ups(t)]])
        kinds.append(np.where(np.arange(len(keys[0])) < entries(t), 0, LOOK_UP).astype(np.uint8))
    if t <= boundary:
        for s, u in pairs_of_sizes(t):
            if u <= boundary:
                subsets = np.array(list(combinations(own, needed(s, u))), np.uint64)
                salt = np.uint64(s * 1000 + u)
                keys.append(mix(mix(subsets ^ salt).sum(1, dtype=np.uint64)))
                kinds.append(np.full(len(subsets), s, np.uint8))
    return np.concatenate(keys), np.concatenate(kinds)


def runs_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of an ascending array, and how often each stands in it.

    Most postings of a bucket are the only one of their set: such counts shrink to nothing in a
    shuffle, which the place of the set beside every posting does not."""
    used, counts = np.unique(at, return_counts=True)
    return used, counts.astype(np.uint32)


def stars(docs: DataFrame, level: np.ndarray, boundary: int, buckets: int) -> DataFrame:
    """(key, kind, rep, rep_size, node, size): each set of a list with the first one entered in it.
    Lists of one set, or without an entry, give no row."""
    shared = docs.sparkSession.sparkContext.broadcast((level, boundary))  # 4 MB
    blobs = fields("bucket int, late int, keys binary, kinds binary, counts binary, nodes binary, "
                   "sizes binary")
    blob_types = to_arrow_schema(blobs)

    def pack(keys, kinds, at, nodes, sizes) -> pa.RecordBatch:
        keys, kinds, at = np.concatenate(keys), np.concatenate(kinds), np.concatenate(at)
        nodes, sizes = np.array(nodes, np.int64), np.array(sizes, np.int32)
        bucket = (mix(keys) % np.uint64(buckets)).astype(np.int64)
        bucket = bucket * 2 + (kinds == LOOK_UP)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(2 * buckets + 1))
        out = {f.name: [] for f in blob_types}
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            mine = order[cuts[b]:cuts[b + 1]]
            used, counts = runs_of(at[mine])
            for name, value in (("bucket", b // 2), ("late", b % 2), ("keys", keys[mine].tobytes()),
                                ("kinds", kinds[mine].tobytes()),
                                ("counts", counts.tobytes()),
                                ("nodes", nodes[used].tobytes()),
                                ("sizes", sizes[used].tobytes())):
                out[name].append(value)
        return to_batch(out, blob_types)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, boundary = shared.value
        hasher, n = Hasher(), 0
        keys, kinds, at, nodes, sizes, seen = [], [], [], [], [], set()
        for part in slices(batches, "text"):
            for own in sets_of(part, hasher):
                node = node_of(own)
                if node is None or node in seen:  # copies a task has just had
                    continue
                seen.add(node)
                k, kind = postings_of(own, level, boundary)
                keys.append(k)
                kinds.append(kind)
                at.append(np.full(len(k), len(nodes), np.int64))
                nodes.append(node)
                sizes.append(len(own))
                n += len(k)
            if n > FLUSH:
                yield pack(keys, kinds, at, nodes, sizes)
                keys, kinds, at, nodes, sizes, seen, n = [], [], [], [], [], set(), 0
        if keys:
            yield pack(keys, kinds, at, nodes, sizes)

    lists = fields("key long, kind int, rep long, rep_size int, node long, size int")
    list_types = to_arrow_schema(lists)

    class Bucket:
        """The different keys entered in a bucket, each with the first set that was.

        Entries come before look-ups, so that look-ups of a key without an entry are let go."""

        def __init__(self) -> None:
            self.keys = np.zeros(0, np.uint64)
            self.rep, self.rep_size = np.zeros(0, np.int64), np.zeros(0, np.int32)
            self.waiting, self.n = [], 0

        def take(self, late: int, keys, kinds, nodes, sizes) -> None:
            if late:
                at = np.searchsorted(self.keys, keys).clip(0, max(0, len(self.keys) - 1))
                known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
                keys, kinds, nodes, sizes = (x[known] for x in (keys, kinds, nodes, sizes))
            if len(keys):
                self.waiting.append((keys, kinds, nodes, sizes))
                self.n += len(keys)

        def flush(self) -> pa.RecordBatch | None:
            if not self.waiting:
                return None
            keys, kinds, nodes, sizes = map(np.concatenate, zip(*self.waiting))
            self.waiting, self.n = [], 0
            unique, first = np.unique(keys, return_index=True)
            if len(self.keys):
                place = np.searchsorted(self.keys, unique).clip(0, len(self.keys) - 1)
                new = self.keys[place] != unique
            else:
                new = np.ones(len(unique), bool)
            merged = np.concatenate([self.keys, unique[new]])
            order = np.argsort(merged, kind="stable")
            self.keys = merged[order]
            self.rep = np.concatenate([self.rep, nodes[first[new]]])[order]
            self.rep_size = np.concatenate([self.rep_size, sizes[first[new]]])[order]
            place = np.searchsorted(self.keys, keys)
            more = np.flatnonzero(self.rep[place] != nodes)
            if not len(more):
                return None
            return to_batch({"key": keys[more].view(np.int64), "kind": kinds[more].astype(np.int32),
                             "rep": self.rep[place[more]], "rep_size": self.rep_size[place[more]],
                             "node": nodes[more], "size": sizes[more]}, list_types)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = (None, None), Bucket()
        for batch in batches:
            for bucket, late, *row in zip(*(batch.column(i).to_pylist() for i in range(2)),
                                          *(batch.column(i) for i in range(2, 7))):
                if (bucket, late) != now or state.n > FLUSH:
                    out = state.flush()
                    if out is not None:
                        yield out
                    if bucket != now[0]:
                        state = Bucket()
                    now = (bucket, late)
                k, kind, counts, nodes, sizes = (
                    np.frombuffer(x.as_buffer(), kind) for x, kind in zip(
                        row, (np.uint64, np.uint8, np.uint32, np.int64, np.int32)))
                state.take(late, k, kind, np.repeat(nodes, counts), np.repeat(sizes, counts))
        out = state.flush()
        if out is not None:
            yield out

    return docs.select("text").mapInArrow(emit, blobs).repartition("bucket") \
        .sortWithinPartitions("bucket", "late").mapInArrow(gather, lists)


def needed_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node, shingles) of the sets named in `chosen` (node, doc_id: one row per set).

    A bitmap of fixed size keeps the others from being shuffled; the join decides."""
    lookup = bitmap_of(chosen, F.col("doc_id"))
    hasher = Hasher()

    def work(part: pa.RecordBatch) -> dict:
        ids = np.array([d or 0 for d in part.column("doc_id").to_pylist()])
        sub = part.take(pa.array(np.flatnonzero(in_bitmap(lookup.value, ids))))
        sets = sets_of(sub, hasher)
        full = [i for i, own in enumerate(sets) if len(own)]
        return {"node": [node_of(sets[i]) for i in full],
                "doc_id": sub.column("doc_id").take(pa.array(full, pa.int64())),
                "shingles": [sets[i].view(np.int64) for i in full]}

    kept = scan_texts(docs.select(F.col("doc_id").cast("long"), "text"), work,
                      fields("node long, doc_id long, shingles array<long>"))
    named = chosen.select(F.col("node").alias("_node"), F.col("doc_id").alias("_doc"))
    return kept.join(named, (F.col("node") == F.col("_node"))
                     & F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi") \
        .select("node", "shingles").dropDuplicates(["node"])


def hopeful(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose parities do not rule a link out."""
    def work(part: pa.RecordBatch) -> dict:
        rows = zip(*(part.column(c).to_pylist() for c in ("x", "y", "s", "t")))
        keep = pa.array([may_link(*r) for r in rows], pa.bool_())
        return {c: part.column(c).filter(keep) for c in ("a", "b")}

    left = places.select(F.col("node").alias("a"), F.col("marks").alias("x"), F.col("n").alias("s"))
    right = places.select(F.col("node").alias("b"), F.col("marks").alias("y"),
                          F.col("n").alias("t"))
    return scan_texts(pairs.join(left, "a").join(right, "b"), work, fields("a long, b long"), "x")


def compare(docs: DataFrame, pairs: DataFrame, places: DataFrame) -> DataFrame:
    """Of pairs (a, b) of different sets, those that link, as (u, v)."""
    if pairs.isEmpty():
        return pairs.toDF("u", "v")
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = settled(needed_sets(docs, places.join(used, "node").select("node", "doc_id")), "needed")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    a, b = SHARE
    both = F.size(F.array_intersect("x", "y"))
    found = settled(pairs.join(right, "b").join(left, "a").where(
        both * (a + b) >= a * (F.size("x") + F.size("y"))).select(
        F.col("a").alias("u"), F.col("b").alias("v")), "found")
    discard(sets)
    return found


def could_link(s: str, t: str):
    a, b = SHARE
    return F.least(s, t) * b >= a * F.greatest(s, t)


def similarity_join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, component, component_id) of every row of `docs` (doc_id, text).

    `component` tells components apart; different ones may have one component_id."""
    units, level = sizes_and_counts(docs)
    sizes = {r[0]: r[1] for r in units.where(F.col("n_shingles").between(1, 2 * MAX_SMALL))
             .groupBy("n_shingles").count().collect()}
    boundary = choose_boundary(sizes)
    volume = units.agg(F.sum(F.expr("n_shingles div 4 + 2"))).first()[0] or 0
    buckets = int(min(MAX_BUCKETS, max(8, volume // BUCKET_POSTINGS)))
    places = settled(units.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"),
        F.min("marks").alias("marks")), "places")
    star = settled(stars(docs, level, boundary, buckets), "stars")

    # subset keys: whatever shares one with a set of the smaller size links with it
    subsets = star.where(f"kind > 0 and kind < {LOOK_UP}")
    members = subsets.select("key", "kind", "node", "size").union(
        subsets.select("key", "kind", F.col("rep"), F.col("rep_size")))
    centre = members.groupBy("key").agg(F.min(F.struct("size", "node")).alias("c"))
    direct = members.join(centre, "key").where("c.size = kind and c.node <> node").select(
        F.col("c.node").alias("u"), F.col("node").alias("v"))

    # inverted lists: every set with the first one of its list
    lists = star.where(f"kind = 0 or kind = {LOOK_UP}")
    meets = could_link("rep_size", "size") & (
        (F.col("kind") == 0) | (F.col("rep_size") <= F.col("size")))
    pairs = settled(hopeful(lists.where(meets).select(
        F.least("rep", "node").alias("a"), F.greatest("rep", "node").alias("b")).distinct(), places),
        "pairs")
    tested = [pairs]
    found = [compare(docs, pairs, places), direct]
    grouped = components(union_all(found))
    members, turn = lists.groupBy("key", "node").agg(
        F.min("kind").alias("kind"), F.min("size").alias("size")), 0
    while True:
        own = members.join(grouped, "node", "left").select(
            "key", "node", "kind", "size", F.coalesce("component", "node").alias("component"))
        unlike = own.groupBy("key").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"),
            F.min("kind").alias("least")).where("lo <> hi and least = 0")
        members = settled(own.join(unlike.select("key"), "key"), "open")
        if members.isEmpty():
            break
        order = F.struct(F.xxhash64("node", F.lit(turn)), "node")
        centres = settled(top_per_key(members.where("kind = 0"), order, FIRST_CENTRES * 16 ** turn),
                          "centres")
        fresh = star_pairs(members, centres, places).distinct()
        for old in tested:
            fresh = fresh.join(old, ["a", "b"], "left_anti")
        tested.append(settled(fresh, "pairs"))
        more = compare(docs, tested[-1], places)
        if not more.isEmpty():
            found.append(more)
            grouped = components(union_all(found))
        members = members.join(centres.select("key", "node"), ["key", "node"], "left_anti") \
            .drop("component")
        turn += 1

    own = places.join(grouped, "node", "left").select(
        "node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = own.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = own.join(least, "component").select("node", "component", "component_id")
    return units.join(ids, "node", "left").select(
        "doc_id", "n_shingles", "node", "component",
        F.coalesce("component_id", "doc_id").alias("component_id"))


def star_pairs(members: DataFrame, centres: DataFrame, places: DataFrame) -> DataFrame:
    """(a, b): centres of lists with members of other components that may link.

    A long list goes to several tasks, each with all its centres; pairs are ruled out where they
    are made, so a row is an open pair and not a meeting."""
    marks = places.select("node", "marks")
    parts = members.groupBy("key").agg(
        F.ceil(F.count("*") / LIST_PART).cast("int").alias("parts"))
    plain = ["key", "node", "size", "component", "marks"]
    listed = members.join(parts, "key").select(
        "key", "node", "size", "component", F.pmod(F.xxhash64("node"), "parts").cast("long").alias("part"),
        F.when(F.col("kind") == 0, 1).otherwise(2).alias("role"))
    chosen = centres.join(parts, "key").select(
        "key", "node", "size", "component",
        F.explode(F.expr("sequence(0L, parts - 1L)")).alias("part"),
        F.lit(0).alias("role"))
    rows = listed.union(chosen).join(marks, "node").select(*plain, "part", "role") \
        .repartition("key", "part").sortWithinPartitions("key", "part", "role")
    schema = fields("a long, b long")
    types = to_arrow_schema(schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stars, out, given = None, None, ([], []), set()
        for batch in batches:
            role = np.asarray(batch.column("role"))
            columns = {c: np.asarray(batch.column(c)) for c in ("node", "size", "component")}
            keys = list(zip(batch.column("key").to_pylist(), batch.column("part").to_pylist()))
            blobs = batch.column("marks").to_pylist()
            for i, key in enumerate(keys):
                if key != now:
                    now, stars = key, Stars()
                row = (int(columns["node"][i]), int(columns["size"][i]),
                       int(columns["component"][i]), blobs[i])
                if role[i] == 0:
                    stars.add(*row)
                else:
                    for other in stars.may_link(*row, entered=role[i] == 1):
                        pair = (min(row[0], other), max(row[0], other))
                        if pair not in given:
                            given.add(pair)
                            out[0].append(pair[0])
                            out[1].append(pair[1])
            if out[0]:
                yield to_batch({"a": out[0], "b": out[1]}, types)
                out = ([], [])
            if len(given) > FLUSH:  # what is given twice is made one later
                given = set()

    return rows.mapInArrow(meet, schema)


class Stars:
    """The centres of a list, their parities stacked by length."""

    def __init__(self) -> None:
        self.rows: dict[int, list] = {}
        self.stacked: dict[int, tuple] = {}

    def add(self, node: int, size: int, component: int, marks: bytes) -> None:
        self.rows.setdefault(len(marks), []).append((node, size, component, marks))

    def may_link(self, node: int, size: int, component: int, marks: bytes, entered: bool) -> list:
        a, b = SHARE
        own, out = np.frombuffer(marks, np.uint8), []
        for n, rows in self.rows.items():
            if n > 2 * len(own) or len(own) > 2 * n:  # sizes too far apart to link
                continue
            if n not in self.stacked:
                self.stacked[n] = (*(np.array(x) for x in zip(*(r[:3] for r in rows))), np.stack(
                    [np.frombuffer(r[3], np.uint8) for r in rows]))
            nodes, sizes, components, bits = self.stacked[n]
            mine = own
            if len(mine) > n:  # fold the longer to the shorter
                mine = mine[:n] ^ mine[n:]
            elif n > len(mine):
                bits = bits[:, :len(mine)] ^ bits[:, len(mine):]
            fit = (components != component) & (nodes != node) & (
                np.minimum(sizes, size) * b >= a * np.maximum(sizes, size))
            if not entered:
                fit &= sizes <= size
            at = np.flatnonzero(fit)
            if len(at):
                apart = np.bitwise_count(bits[at] ^ mine).sum(1)
                out += nodes[at[apart.astype(np.int64) * (a + b) <= (b - a) * (sizes[at] + size)]] \
                    .tolist()
        return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.union(more)
    return out


def top_per_key(members: DataFrame, order, n: int) -> DataFrame:
    """The first n members of every key; a rank limit is applied before the shuffle."""
    return members.withColumn("_n", F.row_number().over(
        Window.partitionBy("key").orderBy(order))).where(F.col("_n") <= n).drop("_n")


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one row of every component, that of the smallest id; documents without words
    all stay.  Of rows that agree in id and shingles one stays."""
    hasher = Hasher()

    def name(part: pa.RecordBatch) -> dict:
        return {"row": part.column("row"), "text": part.column("text"),
                "node": [node_of(x) for x in sets_of(part, hasher)]}

    joined = settled(similarity_join(docs.select("doc_id", "text")), "joined")
    first = joined.where(F.col("node").isNotNull()).groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("f")) \
        .select(F.col("f.doc_id").alias("_doc"), F.col("f.node").alias("_node"))
    rows = packed(docs)
    named = scan_texts(rows, name, fields("text string, node long", rows.schema["row"]))
    doc = F.col("row.doc_id").cast("long")
    kept = named.join(first, (F.col("node") == F.col("_node")) & doc.eqNullSafe(F.col("_doc"))) \
        .withColumn("_n", F.row_number().over(Window.partitionBy("_node", "_doc").orderBy("text"))) \
        .where("_n = 1").select("row", "text")
    return unpacked(kept.union(named.where(F.col("node").isNull()).select("row", "text")),
                    docs.columns, text=F.col("text"))
