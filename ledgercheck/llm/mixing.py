"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

The rows of a source are dealt into blocks of BLOCK_ROWS in an order given by a hash of their id.
With share a of a period of Q slots, block j of a source (from 0) may start at slot j*Q/a, rounded
down, and is due before slot (j+1)*Q/a, rounded up.  In each slot the released block that is due
first is placed.  As the shares fill the period exactly, every block lies in its window: at no
slot is a source a whole block ahead of or behind its target.

The schedule repeats after one period, so only one period is computed; every block finds its slot
by its number in the period.  The work per document is one shuffle by (source, bucket) and joins
with tables of one row per source and of one period, which are broadcast up to FEW_SOURCES sources.

Without weights, targets are by definition whole shares of PERIOD slots, at least one each.  Given
weights are exact: they are whole numbers of the smallest power of ten they have in common, down
to 10^-DIGITS (what is finer is rounded there), and their sum is the period.  The bound holds
against weight / sum of weights of the sources that occur.  One task lays out the period, or as
many slots as there are blocks if these are fewer; blocks beyond these lie behind the part with
the bound, in the order in which they are due.  Sources without a positive weight come last.

When a source runs out its slots stay empty and the order of the rest goes on; `in_mix` marks the
rows before the first missing block, up to which the bound holds.  No row is dropped.

Defined results: a null source is a source of its own; rows with equal ids keep together; an
empty table gives no rows; other columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 64
PERIOD = 1000
DIGITS = 9           # decimal places of given weights
BUCKET_ROWS = 8192   # rows numbered together; a large source has many buckets
FEW_SOURCES = 1024   # up to here tables of sources are broadcast
RUN = 256            # slots of a period decided at once


def shares_by_size(counts: DataFrame, period: int = PERIOD) -> DataFrame:
    """Target shares that flatten sizes: in proportion to the whole square root, at least one."""
    root = F.floor(F.sqrt(F.col("n").cast("double"))).cast("long")
    total = counts.agg(F.sum(root).alias("_total"))
    return counts.join(F.broadcast(total)).select(
        "key", "n", F.greatest(F.lit(1), F.expr(f"{period} * cast(floor(sqrt(n)) as bigint) "
                                                "div _total")).cast("long").alias("share"))


def exact_shares(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """Given weights as whole shares; those of one source add up, all but positive ones are 0."""
    places = f"decimal(38,{DIGITS})"
    given = weights.select(source_key().alias("key"), F.expr(
        f"try_cast(weight AS {places})").alias("w")).where("w > 0").groupBy("key").agg(
        F.expr(f"cast(sum(w) * cast(1e{DIGITS} AS decimal(10,0)) AS bigint)").alias("w"))
    found = counts.join(given, "key", "left").select("key", "n", F.coalesce("w", F.lit(0)).alias("w"))
    # the largest power of ten that divides all of them
    power = found.agg(*[F.max(F.expr(f"w % {10 ** i}L")).alias(f"r{i}")
                        for i in range(1, DIGITS + 1)]).select(F.expr(
        "CASE " + " ".join(f"WHEN r{i} = 0 THEN {10 ** i}L" for i in range(DIGITS, 0, -1))
        + " ELSE 1L END").alias("_power"))
    return found.join(F.broadcast(power)).select(
        "key", "n", F.expr("w div _power").alias("share"))


def schedule(shares: DataFrame, limit: int | None = None) -> DataFrame:
    """One period, or its first `limit` slots: key, share, period, k (number of the block in the
    period) and slot.

    Sources of one share have the same windows, so they take turns in order of their keys; a slot
    is decided between shares, of which a period has few, however many sources it has."""
    row = shares.agg(F.array_sort(F.collect_list(F.struct("key", "share"))).alias("s")) \
        .where(F.size("s") > 0) \
        .withColumn("q", F.aggregate("s", F.lit(0).cast("long"), lambda x, y: x + y["share"])) \
        .withColumn("m", F.least("q", F.lit(limit or 2 ** 62))) \
        .withColumn("c", F.expr("""
            transform(array_sort(array_distinct(s.share)), a -> named_struct('share', a, 'members',
              transform(filter(transform(s, (x, i) -> struct(x.share as share, i as i)),
                               y -> y.share = a), y -> y.i)))"""))
    kind = shares.select(F.struct("key", "share").alias("x")).schema["x"].dataType.simpleString()
    kind = f"{kind[:-1]},k:bigint>"
    # given[n]: blocks of the n-th share placed so far; its sources have had equally many, or one
    # more.  Slots go to runs of RUN, so that no long array is copied slot by slot;
    # z holds values that are not worked out again in every slot
    step = f"""
        transform(array(named_struct('s', s, 'c', c, 'q', q, 'm', m)), z -> aggregate(sequence(0L, (z.m - 1) div {RUN}),
          named_struct('given', transform(z.c, x -> 0L),
                       'out', cast(array() as array<array<{kind}>>)),
          (all, r) -> transform(array(aggregate(sequence(r * {RUN}, least(z.m, (r + 1) * {RUN}) - 1),
            named_struct('given', all.given, 'out', cast(array() as array<{kind}>)),
            (done, t) -> transform(array(array_min(transform(z.c, (x, n) ->
                if((done.given[n] div size(x.members)) * z.q < (t + 1) * x.share,
                   struct(((done.given[n] div size(x.members) + 1) * z.q + x.share - 1) div x.share
                            as due,
                          x.members[cast(done.given[n] % size(x.members) as int)] as i, n as n,
                          done.given[n] div size(x.members) as k), null)))),
              p -> named_struct(
                'given', transform(done.given, (g, n) -> if(n = p.n, g + 1, g)),
                'out', concat(done.out, array(named_struct(
                  'key', z.s[p.i].key, 'share', z.s[p.i].share, 'k', p.k)))))[0])),
            run -> named_struct('given', run.given, 'out', concat(all.out, array(run.out))))[0]).out)[0]"""
    runs = row.select("q", F.expr(step).alias("runs")).select(
        "q", F.posexplode("runs").alias("r", "run"))
    return runs.select("q", "r", F.posexplode("run").alias("t", "o")).select(
        "o.key", "o.share", F.col("q").alias("period"), "o.k",
        F.expr(f"cast(r as bigint) * {RUN} + t").alias("slot"))


def source_key() -> Column:
    """Null and every text get different keys."""
    return F.when(F.col("source").isNull(), F.lit("-")).otherwise(
        F.concat(F.lit("+"), F.col("source").cast("string")))


def order_hash(doc_id: str) -> Column:
    """60 bits of a hash of the id; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
                                    .cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS,
        period: int = PERIOD, columns: list[str] | None = None) -> DataFrame:
    """`row` (the given columns of `docs`) with share, period, block, slot, position, in_mix.

    `weights` (source, weight) gives exact targets; without it shares of `period` slots follow
    `shares_by_size`.
    Sorting by position gives the mixed order.
    """
    columns = columns or docs.columns
    key = source_key()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
                       key.alias("key"), order_hash("doc_id").alias("h"),
                       F.col("doc_id").alias("id"))
    counts = docs.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    # tables of more sources are joined by size
    hinted = F.broadcast if counts.count() <= FEW_SOURCES else lambda df: df
    limit = None
    if weights is None:
        shares = shares_by_size(counts, period)
    else:
        shares = exact_shares(counts, weights)
        limit = counts.agg(F.sum(F.expr(f"(n + {block_rows - 1}) div {block_rows}"))).first()[0]
    plan = hinted(schedule(shares.where("share > 0"), limit))
    small = hinted(shares.select("key", "n", "share"))

    buckets = F.expr(f"(n + {BUCKET_ROWS - 1}) div {BUCKET_ROWS}")
    dealt = rows.join(small, "key").withColumn("bucket", F.pmod("h", buckets))
    sizes = docs.select(key.alias("key"), order_hash("doc_id").alias("h")).join(small, "key") \
        .groupBy("key", F.pmod("h", buckets).alias("bucket")).agg(F.count("*").alias("m"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("key", "bucket",
                           F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    place = Window.partitionBy("key", "bucket").orderBy("h", "id")
    numbered = dealt.withColumn("r", F.row_number().over(place) - 1) \
        .join(offsets, ["key", "bucket"]).withColumn("r", F.col("r") + F.col("base")) \
        .withColumn("block", F.expr(f"r div {block_rows}")) \
        .withColumn("k", F.expr("if(share > 0, block % share, -1)"))
    if weights is not None:
        return _with_tail(numbered, shares, plan, hinted, limit or 0, block_rows)
    slot = F.expr("(block div share) * period + slot")
    # the first block that is missing ends the part with the bound
    last = shares.withColumn("blocks", F.expr(f"(n + {block_rows - 1}) div {block_rows}")) \
        .withColumn("k", F.expr("blocks % share")).join(plan.drop("share"), ["key", "k"]) \
        .agg(F.min(F.expr("(blocks div share) * period + slot")).alias("horizon"))
    return numbered.join(plan.drop("share"), ["key", "k"]).join(F.broadcast(last)).select(
        "row", "share", "period", "block", slot.alias("slot"),
        (slot * block_rows + F.col("r") % block_rows).alias("position"),
        (slot < F.col("horizon")).alias("in_mix"))


def _with_tail(numbered: DataFrame, shares: DataFrame, plan: DataFrame, hinted, limit: int,
               block_rows: int) -> DataFrame:
    """Slots of a schedule that may end early, and of blocks without a target.

    A block the plan has no slot for is due after its last one, so `due * sources + i` is a slot
    behind the plan that no other block has."""
    blocks = F.expr(f"(n + {block_rows - 1}) div {block_rows}")
    every = shares.agg(F.sum("share").alias("q"), F.count("*").alias("sources"),
                       F.array_sort(F.collect_list("key")).alias("_keys"))
    due = "(({j} + 1) * q + share - 1) div share * sources"
    sources = shares.join(F.broadcast(every)).withColumns({
        "i": F.expr("array_position(_keys, key) - 1"), "blocks": blocks}).drop("_keys")
    behind = sources.agg(F.max(F.expr(
        f"if(share > 0, {due.format(j='blocks')} + sources, 0)")).alias("behind"))
    known = "slot IS NOT NULL AND (q <= {limit}L OR {j} < share)".format(limit=limit, j="{j}")
    place = "(({j}) div share) * q + slot"
    # the first block that is missing ends the part with the bound
    last = sources.where("share > 0").withColumn("k", F.expr("blocks % share")).join(
        plan.select("key", "k", "slot"), ["key", "k"], "left").agg(F.min(F.expr(
            f"if({known.format(j='blocks')}, {place.format(j='blocks')}, {limit}L)"))
        .alias("horizon"))
    extra = hinted(sources.select("key", "q", "sources", "i"))
    slot = F.expr(f"""CASE WHEN share = 0 THEN behind + block * sources + i
                           WHEN {known.format(j='block')} THEN {place.format(j='block')}
                           ELSE {due.format(j='block')} + i END""")
    return numbered.join(plan.select("key", "k", "slot"), ["key", "k"], "left").join(
        extra, "key").join(F.broadcast(behind)).join(F.broadcast(last)).select(
        "row", "share", F.col("q").alias("period"), "block", slot.alias("slot"),
        (slot * block_rows + F.col("r") % block_rows).alias("position"),
        F.coalesce(slot < F.col("horizon"), F.lit(False)).alias("in_mix"))
