"""Periodic runs in word sequences by recompression.

The words of many texts lie in one array, each text closed by a mark of its own. Rounds of
block compression (a run of one symbol becomes one symbol) and pair compression (a left
symbol and the right symbol behind it become one) shrink every text to a single symbol;
together the rounds are a run-length grammar of the array. Equal stretches are parsed alike
but for their ends, so the longest common extension of two positions is found by climbing
the grammar while symbols agree and descending where they differ. A run of period q covers
two neighbouring points of the grid 0, q, 2q, ...: pairs of grid points with equal words
are extended both ways, which gives every run exactly, without suffix arrays.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import map_arrow, pick, slices, utf8, with_fields

# Shortest run in words, and least repeats of its period.
LEAST, REPEATS = 12, 2
# Pairs of grid points that are extended together.
TOGETHER = 1 << 18
# The multipliers of a well-known 64-bit mixer.
_STEP = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _left_symbols(symbols: np.ndarray, turn: int) -> np.ndarray:
    """Which symbols stand left in the pairs of a round: a mixed bit of each symbol, so that
    equal symbols always fall on the same side."""
    mixed = symbols.astype(np.uint64) + np.uint64((turn + 1) * _STEP % (1 << 64))
    mixed = (mixed ^ (mixed >> np.uint64(30))) * _MIX[0]
    mixed = (mixed ^ (mixed >> np.uint64(27))) * _MIX[1]
    return (mixed >> np.uint64(40) & np.uint64(1)).astype(bool)


class Grammar:
    """The rounds of recompression over an array of symbols.

    ``symbols[k]``, ``sizes[k]`` (length of each symbol in words) and ``first[k]`` (index of
    its first child in round k - 1) describe round k; ``parent[k]`` leads from round k to
    round k + 1. ``blocks[k]`` tells whether round k + 1 merges runs or pairs. A child's
    place in its parent is its index less the parent's first child. Symbols of the array
    from ``marks`` on are marks; they never merge.
    """

    def __init__(self, words: np.ndarray, marks: int):
        self.symbols, self.sizes = [words.astype(np.int64)], [np.ones(len(words), np.int64)]
        self.first, self.parent, self.blocks = [np.arange(len(words))], [], []
        fresh, turn = int(words.max(initial=0)) + 1, 0
        low, high = marks, fresh  # the marks' symbols
        while True:
            now = self.symbols[-1]
            mark = (now >= low) & (now < high)
            if len(now) < 2 or (mark[1:] | mark[:-1]).all():
                return
            same = (now[1:] == now[:-1]) & ~mark[1:]
            if same.any():
                starts = np.flatnonzero(np.concatenate([[True], ~same]))
                counts = np.diff(np.append(starts, len(now)))
                many = counts > 1
                # A block's symbol belongs to the pair (symbol, length).
                made, code = np.unique(np.stack([now[starts[many]], counts[many]], 1), axis=0,
                                       return_inverse=True)
                fresh = self._add(starts, many, code.reshape(-1), len(made), fresh, True)
                continue
            left = _left_symbols(now, turn)
            turn += 1
            free = ~mark[1:] & ~mark[:-1]
            pairs, swapped = free & left[:-1] & ~left[1:], free & ~left[:-1] & left[1:]
            if np.count_nonzero(swapped) > np.count_nonzero(pairs):
                pairs = swapped
            if not pairs.any():
                continue
            starts = np.flatnonzero(np.concatenate([[True], ~pairs]))
            many = np.append(pairs, False)[starts]
            at = starts[many]
            made, code = np.unique(now[at] * np.int64(fresh) + now[at + 1], return_inverse=True)
            fresh = self._add(starts, many, code, len(made), fresh, False)

    def _add(self, starts, many, code, made: int, fresh: int, block: bool) -> int:
        up = self.symbols[-1][starts]
        up[many] = fresh + code
        parent = np.zeros(len(self.symbols[-1]), np.int64)
        parent[starts[1:]] = 1
        self.parent.append(np.cumsum(parent))
        self.blocks.append(block)
        self.symbols.append(up)
        self.sizes.append(np.add.reduceat(self.sizes[-1], starts))
        self.first.append(starts)
        return fresh + made

    def _last(self, k: int, at: np.ndarray) -> np.ndarray:
        """Last child in round k - 1 of symbols of round k."""
        after = at + 1
        ends = len(self.symbols[k - 1])
        return np.where(after < len(self.first[k]), np.take(self.first[k], after, mode="clip"), ends) - 1

    def extend(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """Words that agree from positions ``a`` and ``b`` on, both included, to the right
        (``step`` 1) or to the left (-1). Each two must lie in one text and differ; the
        marks around it end the agreement."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        total = np.zeros(len(a), np.int64)
        ids = np.arange(len(a))
        stopped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top = len(self.symbols) - 1
        for k in range(top):
            symbol, parent, first = self.symbols[k], self.parent[k], self.first[k + 1]
            up_a, up_b = parent[a], parent[b]
            if step > 0:
                inner_a, inner_b = a - first[up_a], b - first[up_b]
            else:
                inner_a, inner_b = self._last(k + 1, up_a) - a, self._last(k + 1, up_b) - b
            inside = (inner_a > 0) | (inner_b > 0)
            differ = inside & (symbol[a] != symbol[b])
            move = inside & ~differ
            if self.blocks[k]:
                # What is left of both blocks of one symbol, from here in the direction.
                rest_a = self._last(k + 1, up_a) - a if step > 0 else a - first[up_a]
                rest_b = self._last(k + 1, up_b) - b if step > 0 else b - first[up_b]
                shared = np.where(move, np.minimum(rest_a, rest_b) + 1, 0)
                uneven = move & (rest_a != rest_b)
            else:
                shared, uneven = move.astype(np.int64), np.zeros(len(a), bool)
            total[ids] += shared * self.sizes[k][a]
            a, b = a + step * shared, b + step * shared
            halt = differ | uneven
            stopped.append((ids[halt], a[halt], b[halt]))
            go = ~halt
            ids, a, b = ids[go], parent[a[go]], parent[b[go]]
        symbol, size = self.symbols[top], self.sizes[top]
        held = [(ids[:0], a[:0], b[:0])]
        while len(ids):  # at the top a text is one symbol between marks
            halt = symbol[a] != symbol[b]
            held.append((ids[halt], a[halt], b[halt]))
            ids, a, b = ids[~halt], a[~halt], b[~halt]
            total[ids] += size[a]
            a, b = a + step, b + step
        ids, a, b = (np.concatenate(x) for x in zip(*held))
        for k in range(top, 0, -1):
            # Symbols that differ: their children agree up to one place, which is found here.
            if step > 0:
                a, b = self.first[k][a], self.first[k][b]
            else:
                a, b = self._last(k, a), self._last(k, b)
            symbol, parent, first = self.symbols[k - 1], self.parent[k - 1], self.first[k]
            same = symbol[a] == symbol[b]
            if self.blocks[k - 1]:
                rest_a = self._last(k, parent[a]) - a if step > 0 else a - first[parent[a]]
                rest_b = self._last(k, parent[b]) - b if step > 0 else b - first[parent[b]]
                shared = np.where(same, np.minimum(rest_a, rest_b) + 1, 0)
            else:
                shared = same.astype(np.int64)
            total[ids] += shared * self.sizes[k - 1][a]
            a, b = a + step * shared, b + step * shared
            more_ids, more_a, more_b = stopped[k - 1]
            ids, a, b = (np.concatenate(x) for x in ((ids, more_ids), (a, more_a), (b, more_b)))
        return total


def runs_of(sequences: list[np.ndarray]) -> list[np.ndarray]:
    """Of each sequence of word numbers (from 0) its runs as rows (start, length, period), by
    start, then period: every stretch with smallest period q and at least
    max(LEAST, REPEATS * q) words that no neighbour extends."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    some = np.flatnonzero(lengths >= LEAST)
    out = [np.zeros((0, 3), np.int64)] * len(sequences)
    if not len(some):
        return out
    marks = max(int(sequences[i].max()) for i in some) + 1
    # A mark before the first text and behind each.
    parts = [np.array([marks])]
    for n, i in enumerate(some):
        parts += [sequences[i], np.array([marks + 1 + n])]
    flat = np.concatenate(parts).astype(np.int64)
    sizes = lengths[some]
    bases = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    grammar = Grammar(flat, marks)
    found = [np.zeros((0, 4), np.int64)]
    for i, q, owner in _grid(flat, bases, sizes):
        right = grammar.extend(i, i + q, 1)
        left = grammar.extend(i - 1, i + q - 1, -1)
        whole = left + right >= np.maximum(q, LEAST - q)
        i, q, owner, left, right = (x[whole] for x in (i, q, owner, left, right))
        found.append(np.unique(np.stack([owner, i - left - bases[owner], left + right + q, q], 1), axis=0))
    rows = np.unique(np.concatenate(found), axis=0)
    # Of several periods of one stretch the smallest, which sorts first, is its period.
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[fresh]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    ends = np.searchsorted(rows[:, 0], np.arange(len(some)), "right")
    for n, i in enumerate(some):
        out[i] = rows[ends[n - 1] if n else 0:ends[n], 1:]
    return out


def _grid(flat, bases, sizes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Neighbouring grid points with equal words as (position, period, text), for every
    period up to half of a text, in portions."""
    order = np.argsort(sizes, kind="stable")
    held, n = [], 0
    for q in range(1, int(sizes.max()) // REPEATS + 1):
        owners = order[np.searchsorted(sizes[order], REPEATS * q):]
        counts = (sizes[owners] - 1) // q  # points 0, q, ... whose successor is in the text
        owner = np.repeat(owners, counts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = bases[owner] + place * q
        same = flat[at] == flat[at + q]
        if not same.any():
            continue
        at, owner = at[same], owner[same]
        held.append((at, np.full(len(at), q, np.int64), owner))
        n += len(at)
        if n >= TOGETHER:
            yield from _portions(held)
            held, n = [], 0
    if held:
        yield from _portions(held)


def _portions(held):
    joined = [np.concatenate(x) for x in zip(*held)]
    for start in range(0, len(joined[0]), TOGETHER):
        yield tuple(x[start:start + TOGETHER] for x in joined)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words no run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth)[:n] == 0


def planted(doc: int | None, n: int) -> np.ndarray:
    """Which original word stands at each place: a tenth of the ids, by checksum, get a
    periodic end. A row without id keeps its words."""
    at = np.arange(n)
    if doc is None or not n:
        return at
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return at
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at[a:] = a + (at[a:] - a) % p
    return at


def periodic_runs(documents: DataFrame, altered=None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its periodic runs as structs (start,
    length, period) in order of start, then period, and its text with the repeats of all
    runs left out, words joined by one blank.

    Words are the stretches without ASCII white space, compared as they stand. ``altered``
    may name for (doc_id, number of words) which original word stands at each place.
    Null, empty and wordless texts have no runs and an empty collapsed text; a text of under
    LEAST words has no runs. Every row stands for itself, repeated and without id alike; an
    empty table gives an empty result. The runs of a text grow by less than its words.
    """
    rows = pick(documents, "doc_id", "text")
    run = "struct<start: bigint, length: bigint, period: bigint>"
    schema = with_fields(rows.select("doc_id"), f"n_words bigint, runs array<{run}>, collapsed string")
    names = ["start", "length", "period"]

    def scan(batches):
        for part in slices(batches):
            ids = part.column("doc_id")
            texts, sequences, numbers = [], [], {}
            for doc, text in zip(ids.to_pylist(), utf8(part)):
                words = text.split()
                if altered is not None and words:
                    words = [words[i] for i in altered(doc, len(words)).tolist()]
                texts.append(words)
                sequences.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words),
                                             np.int64, len(words)))
            found = runs_of(sequences)
            collapsed = []
            for words, own in zip(texts, found):
                if len(own):
                    kept = np.flatnonzero(kept_words(len(words), own)).tolist()
                    words = [words[i] for i in kept]
                collapsed.append(b" ".join(words).decode("utf-8", "replace"))
            flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            items = pa.StructArray.from_arrays([pa.array(flat[:, c].copy()) for c in range(3)], names)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(t) for t in texts], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), items), pa.array(collapsed, pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    return rows.transform(map_arrow, scan, schema)


def run_table(documents: DataFrame) -> DataFrame:
    """Digest columns of ``periodic_runs`` for texts with planted periods: (doc_id, n_runs;
    start, length, period and exponent_milli of the longest run, ties to the smallest start,
    then period, or nulls; runs_sha256, collapsed_sha256)."""
    found = periodic_runs(documents, planted)
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    some = F.size("runs") > 0
    return (found.withColumn("best", F.when(some, longest))
            .select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"),
                    (-F.col("best.shorter")).alias("length"), F.col("best.period").alias("period"),
                    F.expr("(-1000 * best.shorter) div best.period").alias("exponent_milli"),
                    F.sha2(F.when(some, F.concat(F.array_join(lines, "\n"), F.lit("\n")))
                           .otherwise(F.lit("")), 256).alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256")))
