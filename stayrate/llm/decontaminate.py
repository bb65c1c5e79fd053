"""Benchmark decontamination with a distributed positional inverted index.

The index is document-partitioned: every slice of training documents has, for each term,
the sorted list of its positions in that slice. Test phrases are answered slice by slice:
a phrase that lacks a term there is out at once; otherwise the lists are shifted by the
term's offset in the phrase and intersected, rarest first, until none or all are left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import map_arrow, numbered, pick, slices, stored, utf8

WINDOW = 10
# Words of test items that one pass over the documents looks for. Larger benchmarks are
# answered in several passes, so that what is broadcast stays bounded.
PASS_WORDS = 1_000_000
# Free positions between two documents of a slice; more than any proximity window spans.
GAP = 4096
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127
               else 32 for c in range(256))

INDEX = ("doc_ids array<bigint>, at array<bigint>, sizes array<int>, terms array<int>, "
         "ends array<int>, places array<int>")
HITS = "doc_id bigint, at bigint, n_words bigint, spans array<array<int>>, items array<string>"


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all non-ASCII characters."""
    return text.translate(_WORDS).split()


class Phrases:
    """The windows of a block of items, as term numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.terms: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words(text.encode())]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                found.setdefault(tuple(ids[i:i + size]), set()).add(item)
        self.by_size = {}
        for size in {len(k) for k in found}:
            keys = [k for k in found if len(k) == size]
            self.by_size[size] = np.array(keys, np.int64), [sorted(found[k]) for k in keys]


def index(rows: DataFrame, phrases) -> DataFrame:
    """Posting lists of the phrases' terms, one row per slice of documents."""
    def build(batches):
        terms = phrases.value.terms
        part, done = TaskContext.get().partitionId() << 33, 0
        for piece in slices(batches):
            sizes, flat = [], []
            for text in utf8(piece):
                own = words(text)
                sizes.append(len(own))
                flat.append(np.fromiter((terms.get(w, -1) for w in own), np.int64, len(own)))
            sizes = np.array(sizes, np.int64)
            base = np.cumsum(sizes + GAP) - sizes - GAP
            ids = np.concatenate(flat)
            place = np.arange(len(ids)) + np.repeat(base - (np.cumsum(sizes) - sizes), sizes)
            known = ids >= 0
            ids, place = ids[known], place[known]
            order = np.argsort(ids, kind="stable")
            ids, place = ids[order], place[order]
            cut = np.flatnonzero(np.diff(ids, append=-1)) + 1 if len(ids) else np.zeros(0, int)
            row = {"doc_ids": piece.column("doc_id").to_pylist(),
                   "at": part + done + np.arange(len(sizes)), "sizes": sizes,
                   "terms": ids[cut - 1], "ends": cut, "places": place}
            done += len(sizes)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v if isinstance(v, list) else v.tolist()], pa.list_(kind))
                 for v, kind in zip(row.values(), kinds)], list(row))

    return stored(rows.transform(map_arrow, build, INDEX), "postings")


def _matches(lists, counts, table: np.ndarray, slop: int):
    """For each phrase of one size: (phrase number, starts, ends) of its occurrences; exact
    ones at slop 0, else its words in order with up to ``slop`` others between them."""
    size = table.shape[1]
    for k in np.flatnonzero((counts[table] > 0).all(axis=1)):
        phrase = table[k]
        if slop == 0:
            order = np.argsort(counts[phrase], kind="stable")
            start = lists(phrase[order[0]]) - order[0]
            for o in order[1:]:
                other = lists(phrase[o])
                want = start + o
                at = np.minimum(np.searchsorted(other, want), len(other) - 1)
                start = start[other[at] == want]
                if not len(start):
                    break
            end = start + size
        else:
            start = lists(phrase[0])
            last = start
            for o in range(1, size):
                other = lists(phrase[o])
                at = np.searchsorted(other, last, "right")
                ok = at < len(other)
                start, last = start[ok], other[at[ok]]
                near = last - start < size + slop
                start, last = start[near], last[near]
                if not len(start):
                    break
            end = last + 1
        if len(start):
            yield k, start, end


def search(postings: DataFrame, phrases, slop: int = 0) -> DataFrame:
    """Per document of the index its merged hit spans (word numbers, end excluded) and the
    items with an occurrence."""
    def answer(batches):
        asked = phrases.value
        for batch in batches:
            for row in range(batch.num_rows):
                col = {n: batch.column(n)[row].values.to_numpy(zero_copy_only=False)
                       for n in ("at", "sizes", "terms", "ends", "places")}
                doc_ids, sizes = batch.column("doc_ids")[row].values, col["sizes"].astype(np.int64)
                base = np.cumsum(sizes + GAP) - sizes - GAP
                ends = np.zeros(len(asked.terms), np.int64)
                counts = np.zeros(len(asked.terms), np.int64)
                ends[col["terms"]] = col["ends"]
                counts[col["terms"]] = np.diff(col["ends"], prepend=0)
                places = col["places"].astype(np.int64)
                spans, items = {}, {}
                for table, names in asked.by_size.values():
                    for k, start, end in _matches(
                            lambda t: places[ends[t] - counts[t]:ends[t]], counts, table, slop):
                        for d, a, b in zip((np.searchsorted(base, start, "right") - 1).tolist(),
                                           start.tolist(), end.tolist()):
                            shift = int(base[d])
                            spans.setdefault(d, []).append((a - shift, b - shift))
                            items.setdefault(d, set()).update(names[k])
                n = len(sizes)
                yield pa.RecordBatch.from_arrays([
                    doc_ids, pa.array(col["at"]), pa.array(sizes),
                    pa.array([merged(spans.get(d, [])) for d in range(n)],
                             pa.list_(pa.list_(pa.int32()))),
                    pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string()))],
                    ["doc_id", "at", "n_words", "spans", "items"])

    return postings.transform(map_arrow, answer, HITS)


def merged(spans: list) -> list[list[int]]:
    """Sorted spans without overlap."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def blocks(benchmark: DataFrame, pass_words: int) -> list[DataFrame]:
    """The items dealt by their id to blocks of about ``pass_words`` words."""
    items = pick(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = max(1, -(-total // pass_words))
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]


def matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0,
            pass_words: int = PASS_WORDS) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document row.

    Exact phrases at ``slop`` 0; otherwise proximity matches, a window's words in order with
    at most ``slop`` other words between them. Null and wordless texts have no words; items
    without id, text or words match nothing; repeated items count once, repeated documents
    each. An empty benchmark leaves all spans empty.
    """
    spark = documents.sparkSession
    rows = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                                    "text")
    parts = []
    for block in blocks(benchmark, pass_words):
        # At most about pass_words words: the driver and each task hold one block.
        asked = Phrases([tuple(r) for r in block.collect()], window)
        asked = spark.sparkContext.broadcast(asked)
        parts.append(search(index(rows, asked), asked, slop))
    if len(parts) == 1:
        return parts[0].drop("at")
    # Rows keep their place in the scan (``at``) from pass to pass.
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    together = every.groupBy("at", "doc_id", "n_words").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    ordered = F.array_sort("spans")
    joined = F.aggregate(ordered, F.expr("cast(array() as array<array<int>>)"), _join_span)
    return together.withColumn("spans", joined).drop("at")


def _join_span(out, span):
    last = F.try_element_at(out, F.lit(-1))
    grown = F.concat(F.slice(out, 1, F.size(out) - 1),
                     F.array(F.array(last[0], F.greatest(last[1], span[1]))))
    return F.when((F.size(out) > 0) & (span[0] <= last[1]), grown
                  ).otherwise(F.concat(out, F.array(span)))


def hit_table(documents: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """Per document row: its words, the words inside matches, and the matched items."""
    found = matches(documents, benchmark, **settings)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


def clean_documents(documents: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows without any match, with all columns. Whether a row matches depends on its
    text alone, so rows are found again by a hash of it; ids may be null or repeated."""
    plain, names, at = numbered(documents)
    key = F.xxhash64(F.coalesce(F.col(at["text"]), F.lit("")))
    texts = plain.select(key.alias("doc_id"), F.col(at["text"]).alias("text"))
    found = stored(matches(texts, benchmark, **settings).where("size(spans) > 0")
                   .select(F.col("doc_id").alias("found")).distinct(), "hits")
    return plain.join(found, key == F.col("found"), "left_anti").toDF(*names)
