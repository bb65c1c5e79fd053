"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints within the radius agree on at least two of ``radius + 2`` blocks of their
bits, so distinct fingerprints are bucketed by every pair of blocks. Inside a bucket the
fingerprints are stored vertically, one machine word per 64 of them and bit plane, and the
distances of a whole word to a query advance together in carry-save counters; words in
which every distance has passed the radius are abandoned. Each comparison returns a
spanning forest of its links, and connected components join the forests.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import (cells, deal, local_roots, map_arrow, numbered, pick, runs,
                                  slices, stored, utf8, with_fields)
from stayrate.llm.components import components

BITS = 64
# Rows of a bucket chunk; a comparison task step holds two of them.
CHUNK = 1024
# Digests of rows that are sent to every executor at most, about 100 bytes each there.
MOST_SENT = 1 << 21
_LANES = np.uint64(BITS)


def fingerprint_many(texts: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """64-bit fingerprints: bit b is set where over half of the shingle hashes have it."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for t, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(digest(joined, seed))
            counts[t] = 1
            continue
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        first, last = starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist()
        hashes += [digest(joined[a:b], seed) for a, b in zip(first, last)]
        counts[t] = len(first)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        begins = np.concatenate([[0], np.cumsum(counts[some])])
        values = np.array(hashes, np.uint64)
        # Texts in steps, so that the unpacked bits stay small.
        for a in range(0, len(some), 256):
            b = min(a + 256, len(some))
            for lo, hi, at in _steps(begins, a, b):
                bits = np.unpackbits(values[lo:hi].view(np.uint8).reshape(-1, 8), axis=1,
                                     bitorder="little")
                votes = np.add.reduceat(bits, begins[at] - lo, axis=0, dtype=np.int32)
                over = 2 * votes > counts[some[at]][:, None]
                packed = np.packbits(over, axis=1, bitorder="little")
                out[some[at]] = packed.view(np.uint64).ravel()
    return out


def _steps(begins, a, b, most=1 << 16):
    """Ranges of texts a..b whose hashes number about ``most``; a longer text stands alone."""
    while a < b:
        end = int(np.searchsorted(begins, begins[a] + most, "right")) - 1
        end = min(max(end, a + 1), b)
        yield begins[a], begins[end], np.arange(a, end)
        a = end


def with_fingerprints(texts: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``text`` and other columns to those and ``fp``, the fingerprint as a signed long."""
    others = [c for c in texts.columns if c != "text"]
    schema = with_fields(texts.select(*others), "fp bigint")

    def sign(batches):
        for part in slices(batches):
            fp = fingerprint_many(utf8(part), shingle, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(part.column, others), pa.array(fp)],
                                             [*others, "fp"])

    return texts.transform(map_arrow, sign, schema)


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with at most ``radius`` differing bits between left[i] and
    right[j], by bit-sliced comparison."""
    width = -(-len(right) // BITS)
    padded = np.zeros(width * BITS, np.uint64)
    padded[:len(right)] = right
    lanes = np.arange(BITS, dtype=np.uint64)
    planes, asked = [], []
    for bit in range(BITS):
        column = (padded >> np.uint64(bit)) & np.uint64(1)
        plane = np.bitwise_or.reduce(column.reshape(width, BITS) << lanes, axis=1)
        question = (left >> np.uint64(bit)) & np.uint64(1)
        ones = int(question.sum()) + int(column[:len(right)].sum())
        if 0 < ones < len(left) + len(right):  # a bit that all share adds no distance
            planes.append(plane)
            asked.append((np.uint64(0) - question))
    # Counters start so high that they overflow exactly when a distance passes the radius.
    size = max(1, radius.bit_length())
    start = (1 << size) - 1 - radius
    full = ~np.uint64(0)
    q, w = np.repeat(np.arange(len(left)), width), np.tile(np.arange(width), len(left))
    counters = [np.full(len(q), full if start >> k & 1 else 0, np.uint64) for k in range(size)]
    over = np.zeros(len(q), np.uint64)
    spare = np.uint64(len(right) % BITS)
    if spare:
        over[w == width - 1] = full << spare
    for k, (plane, question) in enumerate(zip(planes, asked), 1):
        carry = plane[w] ^ question[q]
        for c in range(size):
            carry, counters[c] = counters[c] & carry, counters[c] ^ carry
        over |= carry
        if k % 8 == 0:
            open_ = over != full
            if not open_.all():
                q, w, over = q[open_], w[open_], over[open_]
                counters = [c[open_] for c in counters]
            if not len(q):
                break
    found = np.flatnonzero(over != full)
    bits = np.unpackbits((~over[found]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(bits)
    return q[found[at]], w[found[at]] * BITS + lane


def links(fingerprints: DataFrame, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(a, b) links whose components are those of all pairs of the distinct ``fp`` within
    the radius."""
    blocks = radius + 2
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    both = [masks[i] | masks[j] for i, j in combinations(range(blocks), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in both]
    rows = fingerprints.select("fp", F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("band", "bits"))
    shared = stored(rows.groupBy("band", "bits").agg(F.count(F.lit(1)).alias("bucket_rows"))
                    .where("bucket_rows > 1"), "buckets")
    dealt = cells(rows.join(shared, ["band", "bits"]), "fp", F.xxhash64("fp"), chunk)
    keys = ["band", "bits", "lo", "hi"]

    def compare(batches):
        for group in runs(batches, keys):
            fp = group.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
            part = group.column("chunk").to_numpy()
            one, two = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
            i, j = near_pairs(fp[one], fp[two], radius)
            root = local_roots(len(fp), one[i], two[j])
            moved = np.flatnonzero(root != np.arange(len(fp)))
            if len(moved):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp[moved].view(np.int64)), pa.array(fp[root[moved]].view(np.int64))],
                    ["a", "b"])

    return (deal(dealt, keys, keys).select(*keys, "chunk", "fp").transform(map_arrow, compare, "a bigint, b bigint"))


def near_duplicates(documents: DataFrame, shingle: int = 3, radius: int = 3,
                    seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    Null and wordless texts have fingerprint zero and link like any other. Repeated rows
    share a class. Ids of null never name a component: its id is the smallest other one,
    or null where it has none. An empty table gives an empty result.
    """
    signed = stored(with_fingerprints(pick(documents, "doc_id", "text"), shingle, seed), "signed")
    classes = stored(signed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(links(classes.select("fp"), radius))
    rooted = stored(classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")
    names = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "names")
    named = stored(rooted.join(names, "root").select("fp", "component_id"), "named")
    return signed.join(named, "fp").select("doc_id", "fp", "component_id")


def kept_documents(documents: DataFrame, **settings) -> DataFrame:
    """One row of each group of near-duplicates, with all columns."""
    return one_per_group(documents, grouped(documents, **settings))


def grouped(documents: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, h, root) of every row: ``h`` is the text's digest, ``root`` names its group."""
    texts = pick(documents, "doc_id", "text").withColumn("h", text_digest(F.col("text")))
    signed = stored(with_fingerprints(texts, shingle, seed), "signed")
    roots = stored(components(links(signed.select("fp").distinct(), radius)), "roots")
    return signed.join(roots, F.col("fp") == F.col("node"), "left").select(
        "doc_id", "h", F.coalesce("root", "fp").alias("root"))


def text_digest(text: Column) -> Column:
    """128 bits, so that no two texts of even very large tables are taken for one."""
    return F.md5(F.when(text.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), text)))


def row_digest(doc_id: Column, h: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")),
                                  F.lit("\n"), h)))


def _sent(digests: DataFrame) -> DataFrame:
    """``digests`` marked to be broadcast, unless they are too many for an executor."""
    return F.broadcast(digests) if digests.count() <= MOST_SENT else digests


def one_per_group(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of each group: that of the smallest doc_id and, among its texts, the smallest
    text digest; a row without an id only where no row of the group has one. ``groups`` holds
    ``doc_id``, ``h`` and ``root`` of every row.

    Only digests of the rows that go, or that are repeated, are joined with the documents;
    those are broadcast, so that texts stay where they are, and only where there are more than
    MOST_SENT of them are texts shuffled.
    """
    rows = stored(groups.groupBy("root", "doc_id", "h").agg(F.count(F.lit(1)).alias("n")), "rows")
    first = stored(rows.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("first"))
        .select(F.col("root").alias("g"), F.col("first.doc_id").alias("f_id"),
                F.col("first.h").alias("f_h")), "first")
    kept = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h"))
    flags = stored(rows.join(first, F.col("root") == F.col("g")).select(
        row_digest(F.col("doc_id"), F.col("h")).alias("row"), "n", kept.alias("kept"))
        .where("not kept or n > 1"), "flags")
    plain, names, at = numbered(documents)
    keyed = plain.withColumn("row", row_digest(
        F.col(at["doc_id"]), text_digest(F.col(at["text"]))))
    gone = _sent(stored(flags.where("not kept").select("row"), "gone"))
    out = keyed.join(gone, "row", "left_anti")
    repeated = stored(flags.where("kept").select("row"), "repeated")
    if not repeated.isEmpty():
        repeated = _sent(repeated)
        once = out.join(repeated, "row", "left_semi").dropDuplicates(["row"])
        out = out.join(repeated, "row", "left_anti").unionByName(once)
    return out.drop("row").toDF(*names)
