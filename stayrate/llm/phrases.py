"""Phrase collocations from depth-truncated suffix subtrees under vertical partitioning.

Every word of a piece begins a suffix, cut after DEPTH words. The suffixes are parted by
word prefixes: prefixes that begin more of them than one task should hold are lengthened by
a word, pass by pass, and what remains is packed in key order into groups of that budget.
Each group's suffixes go to one place, where their subtree is built independently of the
others; a phrase occurs as often as the leaves below its node say together.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.llm.common import deal_numbered, map_arrow, pick, runs, slices, stored, utf8

DEPTH, LEAST, COVERED, TOP, SCALE = 4, 30, 80, 2000, 2_000_000
# Suffixes that a group should hold, and groups at most: beyond GROUPS * BUDGET words the
# budget grows, so that the number of borders, which every task gets, stays bounded.
BUDGET, GROUPS = 1 << 20, 1 << 18
# Suffixes in one row that is shuffled: the numbers of their words fit into two bytes.
SENT = 1 << 14
# Bytes of text whose equal suffixes are counted together before anything is shuffled.
PORTION = 8 << 20
# Bits of the filter that tells rare words; a rare word that passes costs time only.
FILTER_BITS = 1 << 25
# Lower case for A-Z; a sign or line end that ends a piece becomes a letter that no longer
# occurs then; a tab is a blank.
END = b"A"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r",
                        b"abcdefghijklmnopqrstuvwxyz " + END * 10)
# No word holds a tab, so with one behind each word the keys of the suffixes under a prefix
# are just those that begin with the prefix's key, and they lie together in key order.
TAB, AFTER = b"\t", b"\xff"


def key_of(lang: str, words: list[bytes]) -> bytes:
    return TAB.join([lang.encode("utf-8"), *words, b""])


def word_key(words: DataFrame) -> Column:
    return F.concat(words["lang"], F.lit("\t"), words["word"], F.lit("\t"))


class Numbers(dict):
    """Numbers of words from 1 on, in order of appearance; 0 for the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def numbered_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words, and the sequence of their numbers from 1 on with 0 between pieces."""
    joined = b"\n".join([*texts, b""]).translate(LOWER)
    numbers = Numbers({END: 0})
    words = joined.replace(END, b" " + END + b" ").split()  # blanks alone are left as white space
    sequence = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    return list(numbers)[1:], sequence


def by_language(batches):
    """(language, texts) of portions of the batches. Texts wait until their language has a
    portion, or all languages together have four."""
    own: dict[str, list[bytes]] = {}
    held: dict[str, int] = {}
    for part in slices(batches):
        for lang, text in zip(part.column("lang").to_pylist(), utf8(part)):
            own.setdefault(lang, []).append(text)
            held[lang] = held.get(lang, 0) + len(text)
        every = sum(held.values()) >= 4 * PORTION
        for lang in [x for x, size in held.items() if every or size >= PORTION]:
            held.pop(lang)
            yield lang, own.pop(lang)
    yield from own.items()


def strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string(), safe=False)


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of every word."""
    def count(batches):
        for lang, texts in by_language(batches):
            known, sequence = numbered_words(texts)
            if known:
                n = np.bincount(sequence, minlength=len(known) + 1)[1:]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(known)), strings(known), pa.array(n)], ["lang", "word", "n"])

    counts = rows.transform(map_arrow, count, "lang string, word string, n bigint")
    return counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def frequent_bits(words: DataFrame) -> bytes:
    """A filter of the words' keys: two bits of each are set. Its size is fixed; Spark combines
    it 64 bits at a time."""
    hashed = words.select(F.xxhash64(word_key(words)).alias("h"))
    at = F.explode(F.array(F.pmod("h", F.lit(FILTER_BITS)),
                           F.pmod(F.shiftrightunsigned("h", 32), F.lit(FILTER_BITS)))).alias("at")
    blocks = (hashed.select(at).groupBy(F.shiftright("at", 6).alias("block"))
              .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).collect())
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for block, value in blocks:
        bits[block] = value
    return bits.tobytes()


def passes(bits: bytes, key: bytes) -> bool:
    value = xxhash.xxh64_intdigest(key, 42)
    return all(bits[at >> 3] >> (at & 7) & 1
               for at in (value % FILTER_BITS, (value >> 32) % FILTER_BITS))


def suffix_counts(sequence: np.ndarray, depth: int, at: np.ndarray | None = None):
    """(rows, n): distinct suffixes of ``depth`` words, from all words on or from those at
    ``at``, as rows that hold 0 from the end of their piece on, and their numbers."""
    at = np.flatnonzero(sequence) if at is None else at
    padded = np.concatenate([sequence, np.zeros(depth, np.int64)])
    width = int(sequence.max(initial=0)) + 1
    code, codes, columns, inside = np.zeros(len(at), np.int64), 1, [], np.ones(len(at), bool)
    for d in range(depth):
        inside &= padded[at + d] > 0
        columns.append(np.where(inside, padded[at + d], 0))
        if codes * width >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            codes = len(at)
        code = code * width + columns[-1]
        codes *= width
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return np.stack([c[first] for c in columns], axis=1), n


def frequent_sequence(lang: str, texts: list[bytes], bits: bytes):
    """``numbered_words`` of the words that pass the filter; others end a suffix."""
    known, sequence = numbered_words(texts)
    passed = np.array([False, *(passes(bits, key_of(lang, [w])) for w in known)])
    number = np.where(passed, np.cumsum(passed), 0)
    return [w for w, ok in zip(known, passed[1:].tolist()) if ok], number[sequence]


def longer_prefixes(rows: DataFrame, heavy: list[str], depth: int, bits) -> DataFrame:
    """(key, n): the suffixes of ``depth`` words under the heavy prefixes, one word shorter,
    and how often they occur. A suffix that ends with its prefix stands for itself."""
    wanted = sorted(k.encode("utf-8") for k in heavy)

    def count(batches):
        keys = set(wanted)
        for lang, texts in by_language(batches):
            known, sequence = frequent_sequence(lang, texts, bits.value)
            names = [b"", *known]
            head = [False]
            for word in known:
                key = key_of(lang, [word])
                at = bisect_left(wanted, key)
                head.append(at < len(wanted) and wanted[at].startswith(key))
            found, n = suffix_counts(sequence, depth, np.flatnonzero(np.array(head)[sequence]))
            paths = [[names[i] for i in row if i] for row in found.tolist()]
            kept = [(key_of(lang, p), c) for p, c in zip(paths, n.tolist())
                    if key_of(lang, p[:depth - 1]) in keys]
            if kept:
                yield pa.RecordBatch.from_arrays(
                    [strings([k for k, _ in kept]), pa.array([c for _, c in kept], pa.int64())], ["key", "n"])

    counts = rows.transform(map_arrow, count, "key string, n bigint")
    return counts.groupBy("key").agg(F.sum("n").alias("n"))


def borders(rows: DataFrame, words: DataFrame, bits, budget: int = BUDGET) -> list[bytes]:
    """First keys of the groups in order: prefixes packed in key order up to the budget."""
    budget = max(budget, (words.agg(F.sum("n")).first()[0] or 0) // GROUPS)
    level, parts = words.select(word_key(words).alias("key"), "n"), []
    for depth in range(2, DEPTH + 1):
        parts.append(level.where(F.col("n") <= budget))
        # Fewer than words / budget prefixes of one length can be heavier than the budget.
        heavy = [r.key for r in level.where(F.col("n") > budget).select("key").collect()]
        if not heavy:
            break
        level = stored(longer_prefixes(rows, heavy, depth, bits), "prefixes")
    else:
        parts.append(level)  # whole suffixes: equal ones are one leaf, however many
    for part in parts[1:]:
        parts[0] = parts[0].unionByName(part)

    def pack(batches):
        held, starts = budget, []
        for batch in batches:
            for key, n in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist()):
                if held + n > budget:
                    starts.append(key)
                    held = 0
                held += n
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.string())], ["key"])

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = stored(parts[0], "parts").repartitionByRange(width, "key").sortWithinPartitions("key")
    # Two neighbouring groups of a partition hold more than the budget together, so these are
    # at most twice words / budget and two for each partition.
    return sorted(r.key.encode("utf-8") for r in ordered.transform(map_arrow, pack, "key string").collect())


PLACES = [f"w{d}" for d in range(DEPTH)]
SHORT = 1 << 15


def leaves(rows: DataFrame, starts, bits) -> DataFrame:
    """(group, lang, words, w0 ..., counts): distinct suffixes of a portion that belong to a
    group. ``words`` are parted by tabs; ``w0`` and so on hold the number among them of each
    suffix's words, from 1 on and 0 behind its end, less SHORT."""
    def ship(batches):
        first = starts.value
        for lang, texts in by_language(batches):
            known, sequence = frequent_sequence(lang, texts, bits.value)
            found, n = suffix_counts(sequence, DEPTH)
            if not len(found):
                continue
            names = [b"", *known]
            keys = [key_of(lang, [w]) for w in names]
            low = np.array([bisect_right(first, k) - 1 for k in keys])
            high = np.array([bisect_right(first, k + AFTER) - 1 for k in keys])
            group = low[found[:, 0]]
            cut = np.flatnonzero((low != high)[found[:, 0]])
            for i, row in zip(cut.tolist(), found[cut].tolist()):
                group[i] = bisect_right(first, key_of(lang, [names[j] for j in row if j])) - 1
            group = np.maximum(group, 0)
            order = np.argsort(group, kind="stable")
            found, n, group = found[order], n[order], group[order]
            cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
            parts = [(c, min(c + SENT, b)) for a, b in zip(cuts, [*cuts[1:], len(group)])
                     for c in range(a, b, SENT)]
            words, numbers = [], np.zeros(found.shape, np.int16)
            for a, b in parts:
                used, local = np.unique(np.append(0, found[a:b].reshape(-1)), return_inverse=True)
                words.append(TAB.join([names[i] for i in used[1:].tolist()]))
                numbers[a:b] = local[1:].reshape(-1, DEPTH) - SHORT
            ends = pa.array(np.array([0, *(b for _, b in parts)], np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[[a for a, _ in parts]].astype(np.int32)), pa.array([lang] * len(parts)),
                 strings(words),
                 *(pa.ListArray.from_arrays(ends, pa.array(numbers[:, d].copy())) for d in range(DEPTH)),
                 pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))],
                ["group", "lang", "words", *PLACES, "counts"])

    lists = "".join(f"{p} array<smallint>, " for p in PLACES)
    return rows.transform(map_arrow, ship, f"group int, lang string, words string, {lists}counts array<int>")


def gathered(table: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, rows, counts) of the suffixes of a table of ``leaves``, numbered alike."""
    table = table.combine_chunks()
    lists = {c: table.column(c).combine_chunks() for c in ("words", *PLACES, "counts")}
    lists["words"] = pc.split_pattern(lists["words"], "\t")
    words = lists["words"].flatten().dictionary_encode()
    number = np.append(0, words.indices.to_numpy() + 1)
    # Where the words of each row begin in the list of all, and the suffixes of each row.
    base = np.append(0, np.cumsum(lists["words"].value_lengths().to_numpy()))[:-1]
    base = np.repeat(base, lists["counts"].value_lengths().to_numpy())
    columns = []
    for place in PLACES:
        local = lists[place].flatten().to_numpy().astype(np.int64) + SHORT
        columns.append(number[np.where(local > 0, base + local, 0)])
    return (["", *words.dictionary.to_pylist()], np.stack(columns, axis=1),
            lists["counts"].flatten().to_numpy().astype(np.int64))


def subtree(found: np.ndarray, n: np.ndarray):
    """(rows, totals) by depth: the nodes of that depth, as the index of a suffix below each
    and the sum of the leaves below it."""
    pairs = [found[:, d] << 32 | found[:, d + 1] for d in range(0, found.shape[1], 2)]
    order = np.lexsort(pairs[::-1])
    found, n = found[order], n[order]
    fresh = np.zeros(len(found), bool)
    fresh[0] = True
    for d in range(found.shape[1]):
        fresh[1:] |= found[1:, d] != found[:-1, d]
        at = np.flatnonzero(fresh)
        node = found[at, d] > 0
        yield order[at[node]], np.add.reduceat(n, at)[node]


def phrase_counts(rows: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, m, f) of the phrases of m <= DEPTH words that occur ``least`` times."""
    context = rows.sparkSession.sparkContext
    frequent = words.where(F.col("n") >= least)
    bits = context.broadcast(frequent_bits(frequent))  # of fixed size
    starts = context.broadcast(borders(rows, frequent, bits))  # at most about 2 * GROUPS keys

    def build(batches):
        first = starts.value
        for table in runs(batches, ["group"]):
            group = table.column("group")[0].as_py()
            for lang in pc.unique(table.column("lang")).to_pylist():
                names, found, counts = gathered(table.filter(pc.equal(table.column("lang"), lang)))
                # Prefixes that the borders of this group cut go on in its neighbours.
                cut = set()
                for start in first[group:group + 2]:
                    start, head = start.decode("utf-8"), lang + "\t"
                    if start.startswith(head):
                        path = start[len(head):-1].split("\t")
                        cut |= {tuple(path[:d]) for d in range(1, len(path))}
                number = {w: i for i, w in enumerate(names)} if cut else {}
                for d, (at, total) in enumerate(subtree(found, counts), 1):
                    kept = total >= least
                    for path in cut:
                        if len(path) == d and all(w in number for w in path):
                            kept |= (found[at, :d] == [number[w] for w in path]).all(axis=1)
                    if kept.any():
                        phrases = [" ".join([names[i] for i in row]) for row in found[at[kept], :d].tolist()]
                        m = len(phrases)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * m), pa.array(phrases, pa.string()),
                             pa.array([d] * m, pa.int32()), pa.array(total[kept])],
                            ["lang", "phrase", "m", "f"])

    counted = deal_numbered(leaves(rows, starts, bits), "group").transform(map_arrow, build, "lang string, phrase string, m int, f bigint")
    return counted.groupBy("lang", "phrase", "m").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def collocations(documents: DataFrame, least: int = LEAST, covered: int = COVERED,
                 top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces
    into words at blanks and tabs. A phrase is 2 to 4 words of a piece that occur together a
    >= ``least`` times, overlaps included. Its worst cut into two parts that occur l and r
    times gives the score floor(2000000 * a / (l + r)), equal ones go to the first cut. A
    phrase inside a longer one that occurs at least ``covered`` percent as often is left out.
    Order: score, a, phrase; n is the language's number of words.

    A null text is empty; a null language is ``und``; repeated rows count each, and ids play
    no part. An empty table, or one without a phrase, gives an empty result.
    """
    rows = pick(documents, "lang", "text").select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    words = stored(word_counts(rows), "words")
    counts = stored(phrase_counts(rows, words, least), "phrases")
    parted = counts.where("m > 1").select("lang", "phrase", F.col("f").alias("a"), "m",
                                          F.split("phrase", " ").alias("w"))

    cuts = parted.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("one"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("two"))
    for part, name in (("one", "l"), ("two", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)),
                         ["lang", part])
    # Decimals, because the products may pass 64 bits; div drops the fraction.
    score = F.expr(f"cast(a as decimal(19,0)) * {SCALE} div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    worst = (cuts.withColumn("score", score).groupBy("lang", "phrase", "a")
             .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))

    inner = (parted.where("m > 2").withColumn("length", F.explode(F.sequence(F.lit(2), F.col("m") - 1)))
             .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("length") + 1)))
             .groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("length")), " ").alias("phrase"))
             .agg(F.max("a").alias("longer")))
    alone = F.expr(f"longer is null or cast(longer as decimal(19,0)) * 100 < cast(a as decimal(19,0)) * {int(covered)}")
    left = worst.join(inner, ["lang", "phrase"], "left").where(alone).select(
        "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return first.join(total, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
