"""Helpers of the training-data operators: columns, written tables, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.session import new_folder, ship

# Bytes of text that one step inside a Python worker holds as words at a time.
SLICE_BYTES = 2 << 20


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns. Names match exactly, so columns that differ from them only by
    case, or stand twice, do no harm."""
    at = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{at[name]}").alias(name) for name in names])


def numbered(df: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """All columns under neutral names, the old names in order, and old name -> new name."""
    names = df.columns
    fresh = [f"_{i}" for i in range(len(names))]
    return df.toDF(*fresh), names, {n: f for n, f in reversed(list(zip(names, fresh)))}


def with_fields(df: DataFrame, fields: str) -> T.StructType:
    """The schema of ``df`` and, behind it, the fields of a DDL string."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(fields).fields])


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow``, with this package shipped to the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost
    executors, and lets adaptive execution split skewed joins on it."""
    spark = df.sparkSession
    path = new_folder(spark, f"llm-{label}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of the batches that hold about ``limit`` bytes of text; a longer text
    stands alone and whole."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """The texts as bytes; null is empty."""
    values = batch.column(text).cast(pa.large_binary()).to_pylist()
    return [b"" if v is None else v for v in values]


def runs(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal ``keys`` from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(n, bool)
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
        new[0] = last is not None and any(c[0] != v for c, v in zip(columns, last))
        cuts = np.flatnonzero(new)
        if len(cuts):
            if held or cuts[0]:
                yield pa.Table.from_batches([*held, batch.slice(0, cuts[0])])
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield pa.Table.from_batches([batch.slice(a, b - a)])
            held = [batch.slice(cuts[-1])]
        else:
            held.append(batch)
        last = [c[-1] for c in columns]
    if held:
        yield pa.Table.from_batches(held)


def deal(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows with equal ``by`` together and sorted by ``order``, in as many partitions as
    ``spark.sql.shuffle.partitions`` says: adaptive execution sizes partitions by bytes and
    would put comparisons, which are much work on few bytes, into a handful of tasks."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *by).sortWithinPartitions(*order)


def deal_numbered(df: DataFrame, number: str) -> DataFrame:
    """Rows sorted by ``number``, an integer from 0 on, and dealt by it: consecutive numbers go
    to consecutive partitions, so that as many of them as there are fill all evenly."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionById(width, number).sortWithinPartitions(number)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links i-j."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all():
            break
    while (root != root[root]).any():
        root = root[root]
    return root


def cells(sized: DataFrame, key: str, hashed: F.Column, most: int) -> DataFrame:
    """Deal each bucket out to cells of at most about ``2 * most`` rows.

    ``sized`` holds a bucket's row count in ``bucket_rows``. A bucket is cut into ``s``
    chunks by ``hashed``; the cells are its pairs of chunks, so that any two rows meet in
    exactly one cell. A bucket of up to ``most`` rows is one cell. Adds ``chunk``, ``lo``
    and ``hi``.
    """
    s = F.ceil(F.col("bucket_rows") / F.lit(most)).cast("int")
    chunked = sized.withColumn("chunks", s).withColumn(
        "chunk", F.pmod(hashed, F.col("chunks")).cast("int"))
    return (chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other"))
            .drop("other", "chunks", "bucket_rows"))
