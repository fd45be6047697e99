"""Helpers all operators share: Arrow scans, settled tables, whole-package shipping."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgercheck.session import work_folder

# Tasks get the code of this package with the job, so that executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules["ledgercheck"])

SLICE_BYTES = 1 << 19  # text handled at once in a task, or one row if that is longer


# Rows of text go to tasks in small batches, so that two tasks fit beside an executor's heap.
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def small_batches(spark: SparkSession) -> None:
    for key, value in ARROW_SETTINGS.items():
        spark.conf.set(key, value)


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = work_folder(spark, f"llm-{name}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove settled tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def learned(doc_id="doc_id"):
    """True for rows that may be learned from: crc32 of the id as text, mod 4, is not 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2, F.lit(True))


def sample_by_hash(df: DataFrame, column: str, rows: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows with the `rows` lowest hashes of a column (per group of `by`), one per hash.

    Only hashes are ranked; they are at most `rows` per group and tell which rows are fetched.
    Hashes are even, so of a group with many, those beyond four times the share that is wanted
    can't be among the lowest: they go before the rank, and no task ranks a whole group."""
    h = F.xxhash64(column).alias("_h")
    keys = df.select(*by, h).distinct()
    if by:
        sizes = keys.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(
            F.count("*").alias("_size"))
        same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
        spot = F.col("_h") / float(1 << 64) + 0.5
        keys = keys.join(sizes, same).where(
            spot * F.col("_size") <= 4.0 * rows + 64).select(*by, "_h")
        order = Window.partitionBy(*by).orderBy("_h")
        keys = keys.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rows)
    else:
        keys = keys.orderBy("_h").limit(rows)
    return df.withColumn("_h", F.xxhash64(column)).join(
        F.broadcast(keys.select(*by, "_h")), [*by, "_h"]).dropDuplicates([*by, "_h"]).drop("_h")


def fit_in_task(sample: DataFrame, fit: Callable[[list[dict]], dict]) -> dict:
    """What `fit` makes of the rows of a bounded sample, worked out in one task, so that the
    driver holds the model only."""
    small_batches(sample.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit(rows))]},
                                         pa.schema([("model", pa.binary())]))

    found = sample.repartition(1).mapInArrow(work, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([])  # no task runs without rows


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the offsets of each row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most SLICE_BYTES of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def fields(ddl: str, *more: T.StructField) -> T.StructType:
    """Columns of a DDL text, plus columns that are passed through."""
    return T.StructType([*T.StructType.fromDDL(ddl).fields, *more])


def scan_texts(df: DataFrame, work: Callable[[pa.RecordBatch], dict | None],
               schema: T.StructType, text: str = "text") -> DataFrame:
    """Run `work` over slices of rows; it returns the output columns (name: values)."""
    types = to_arrow_schema(schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            out = work(part)
            if out is not None:
                yield to_batch(out, types)

    return df.mapInArrow(run, schema)


def packed(df: DataFrame, text: str = "text") -> DataFrame:
    """`row` with every other column, and `text`: names of other columns can't clash."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != text]
    return df.select(F.struct(*rest).alias("row"), F.col(text).alias("text"))


def unpacked(df: DataFrame, columns: list[str], **changed) -> DataFrame:
    """The columns of a table again, some of them changed."""
    return df.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def to_batch(columns: dict, types: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in types:
        values = columns[field.name]
        if isinstance(values, (pa.Array, pa.ChunkedArray)):
            values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
            arrays.append(values if values.type == field.type else values.cast(field.type))
        else:
            arrays.append(pa.array(values, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(
        [pa.field(f.name, f.type, True) for f in types]))


def sized_broadcast(spark: SparkSession, value, n_bytes: int, bound: int, what: str):
    """Broadcast a value whose size was measured; refuse one beyond its documented bound."""
    if n_bytes > bound:
        raise ValueError(f"{what}: {n_bytes} bytes exceed the broadcast bound of {bound}")
    return spark.sparkContext.broadcast(value)


BITMAP_BITS = 1 << 26


def bitmap_of(df: DataFrame, number: Column):
    """Broadcast bitmap (8 MB at any size) of the low 26 bits of a whole number; null counts as 0.

    It keeps most rows that a join would drop from being shuffled; the join itself decides."""
    spot = F.coalesce(number, F.lit(0)).cast("long").bitwiseAND(F.lit(BITMAP_BITS - 1))
    found = df.select(spot.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    # a bucket holds 32768 positions, from 1 on; position 0 has bucket 0 for itself
    bits = np.zeros(BITMAP_BITS // 8 + 4096, np.uint8)
    for b, blob in found:
        part = np.frombuffer(blob, np.uint8)
        bits[b * 4096:b * 4096 + len(part)] = part
    return df.sparkSession.sparkContext.broadcast(bits)


def in_bitmap(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    spot = numbers.astype(np.int64) & (BITMAP_BITS - 1)
    at = np.where(spot > 0, spot + 32767, 0)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
