"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosines, components.

Equal vectors are one class. Each class is hashed into several tables by the signs of its
products with random hyperplanes; classes that share a bucket are compared by their cosine
in double precision. Bits grow with the logarithm of the number of classes, so buckets
keep their expected size, and tables are added to hold the recall at the threshold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.llm.common import cells, deal, local_roots, map_arrow, pick, runs, stored
from stayrate.llm.components import components

CHUNK = 512
SEED = 1729
# Expected classes in a bucket, were directions random, and the recall at the threshold.
BUCKET_ROWS, RECALL = 16, 0.98


def layout(classes: int, threshold: float) -> tuple[int, int]:
    """(bits, tables): bits for buckets of about BUCKET_ROWS, and as many tables as give
    two vectors at the threshold a common bucket with probability RECALL."""
    bits = min(31, max(8, math.ceil(math.log2(max(classes, 1) / BUCKET_ROWS + 1))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - agree))


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, without overflow."""
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def linkable(vector) -> F.Column:
    """Vectors with a direction: not null, not zero, no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_links(classes: DataFrame, threshold: float, chunk: int = CHUNK) -> DataFrame:
    """(a, b, n): per comparison and class ``a``, the vectors ``n`` in classes it links with
    there, and the smallest class ``b`` it reaches there. No link is counted twice.

    ``classes`` holds id, n (vectors in the class) and vector.
    """
    bits, tables = layout(classes.count(), threshold)
    single = classes.schema["vector"].dataType.elementType == T.FloatType()
    kind = np.float32 if single else np.float64
    hashed_type = "id bigint, n bigint, dim int, vector binary, signs array<int>"

    def sign(batches):
        for batch in batches:
            ids, n = batch.column("id"), batch.column("n")
            column = batch.column("vector")
            dims = np.diff(np.asarray(column.offsets))
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
            starts = np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                vectors = flat[starts[at][:, None] + np.arange(dim)]
                positive = unit(vectors) @ planes(int(dim), bits, tables) > 0
                codes = positive.reshape(-1, tables, bits) @ (1 << np.arange(bits))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([
                    ids.take(take), n.take(take), pa.array(np.full(len(at), dim, np.int32)),
                    pa.array([v.tobytes() for v in vectors], pa.binary()),
                    pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32()))],
                    ["id", "n", "dim", "vector", "signs"])

    hashed = stored(classes.select("id", F.col("n").cast("bigint"), "vector")
                    .transform(map_arrow, sign, hashed_type), "signs")
    rows = hashed.select("*", F.posexplode("signs").alias("table", "code"))
    bucket = ["dim", "table", "code"]
    shared = stored(hashed.select("dim", F.posexplode("signs").alias("table", "code"))
                    .groupBy(*bucket).agg(F.count(F.lit(1)).alias("bucket_rows"))
                    .where("bucket_rows > 1"), "buckets")
    dealt = cells(rows.join(shared, bucket), "id", F.xxhash64("id"), chunk)
    keys = [*bucket, "lo", "hi"]

    def compare(batches):
        for group in runs(batches, keys):
            ids = group.column("id").to_numpy()
            weight = group.column("n").to_numpy()
            part = group.column("chunk").to_numpy()
            table = group.column("table")[0].as_py()
            signs = np.stack(group.column("signs").to_numpy())
            vectors = unit(np.stack([np.frombuffer(v, kind)
                                     for v in group.column("vector").to_pylist()]))
            lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
            one, two = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
            i, j = np.nonzero(vectors[one] @ vectors[two].T >= threshold)
            i, j = one[i], two[j]
            if lo == hi:
                i, j = i[i < j], j[i < j]
            # A pair counts in the first table that brings it together.
            mine = (signs[i, :table] != signs[j, :table]).all(axis=1)
            i, j = i[mine], j[mine]
            if not len(i):
                continue
            total = np.zeros(len(ids), np.int64)
            np.add.at(total, i, weight[j])
            np.add.at(total, j, weight[i])
            order = np.argsort(ids, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            root = ids[order][local_roots(len(ids), place[i], place[j])][place]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[some]), pa.array(root[some]), pa.array(total[some])], ["a", "b", "n"])

    return (deal(dealt, keys, keys)
            .select(*keys, "chunk", "id", "n", "vector", "signs")
            .transform(map_arrow, compare, "a bigint, b bigint, n bigint"))


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    A vector that is null, empty, zero or not finite links with nothing and is its own
    component. So is a row without vec_id, whose component is null and which is not kept.
    Repeated rows are vectors of one class, linked with each other. Vectors of different
    lengths do not link. An empty table gives an empty result.
    """
    rows = pick(embeddings, "vec_id", "embedding").select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("vector"))
    able = linkable(F.col("vector")) & F.col("vec_id").isNotNull()
    classes = stored(rows.where(able).groupBy("vector").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    found = stored(near_links(classes, threshold), "found")
    counts = stored(found.groupBy("a").agg(F.sum("n").alias("others")), "counts")
    roots = components(found.select("a", "b"))
    named = stored(
        classes.join(counts, F.col("id") == F.col("a"), "left")
        .join(roots, F.col("id") == F.col("node"), "left")
        .select("vector", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"),
                F.coalesce("root", "id").alias("root")), "named")
    joined = (rows.withColumn("v", F.when(able, F.col("vector"))).drop("vector")
              .join(named, F.col("v") == F.col("vector"), "left"))
    component = F.coalesce("root", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
