"""Encoding and decoding with a byte-level BPE vocabulary by a pair occurrence index.

The distinct pre-tokens of a portion of texts lie in one array of symbols that are linked to
their neighbours. An index maps the rank of each adjacent pair to all its positions. Active
ranks are taken in ascending order; all positions of a rank merge, from the left, and the
lists of the pairs that vanish and appear around them are brought up to date. Positions of
vanished pairs are recognised when their list is read.
"""

from __future__ import annotations

import json
from array import array
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import map_arrow, pick, slices, utf8, with_fields

# Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Letters of the pre-tokens whose ids a worker remembers, the ones it meets first.
REMEMBERED = 6 << 20
# Bytes up to which symbols stand in lists, which are faster than compact arrays.
IN_LISTS = 4 << 20
# Ids that one step of decoding holds.
IDS = 1 << 19


class Vocabulary:
    """A byte-level BPE file: ids of bytes and merges, bytes of ids, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model, before = stored["model"], stored.get("pre_tokenizer") or {}
        added = stored.get("added_tokens", [])
        if (model["type"] != "BPE" or before.get("type") != "ByteLevel" or stored.get("normalizer")
                or before.get("add_prefix_space") or not before.get("use_regex", True)
                or model.get("ignore_merges") or (stored.get("decoder") or {}).get("type") != "ByteLevel"
                or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        # A printable byte stands for itself, the others in order for the letters from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.byte_ids = [0] * 256
        for letter, byte in byte_of.items():
            self.byte_ids[byte] = vocab[letter]
        self.special = {t["content"]: t["id"] for t in added}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, number in chain(vocab.items(), self.special.items()):
            known = all(c in byte_of for c in token)
            self.bytes_of[number] = bytes(byte_of[c] for c in token) if known else token.encode()
        # pair -> rank, and by rank the left, right and made symbol.
        self.rank, self.parts = {}, []
        self.known: Known | None = None  # of the worker that holds this copy
        made_at: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            if max(made_at.get(left, -1), made_at.get(right, -1), made_at.get(made, -1)) >= rank:
                raise ValueError("a merge of this vocabulary uses a symbol of a later one")
            made_at[made] = rank
            self.rank[left, right] = rank
            self.parts.append((left, right, made))
        if any(made_at.get(s, -1) > r for r, (a, b, _) in enumerate(self.parts) for s in (a, b)):
            raise ValueError("a symbol of this vocabulary is made again after it is used")
        pairs = np.array([(a << 32) + b for a, b in self.rank], np.int64)
        self.pair_ranks = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.pair_ranks]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 for none."""
        pair = (left.astype(np.int64) << 32) + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.pair_ranks[at], -1)


def merged(vocabulary: Vocabulary, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes): ids of the non-empty byte strings one after another, and how many each has.

    A merge makes a symbol that is used by higher ranks only, so a rank is complete once it
    has been taken, and all its positions in all strings can merge together.
    """
    joined = b"".join(tokens)
    n = len(joined)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    symbols = np.array(vocabulary.byte_ids, np.int64)[np.frombuffer(joined, np.uint8)]
    # Neighbours within the string; -1 at its ends.
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1] = -1
    before[ends[:-1]] = -1
    inside = np.flatnonzero(after >= 0)
    ranks = vocabulary.ranks(symbols[inside], symbols[inside + 1])
    inside, ranks = inside[ranks >= 0], ranks[ranks >= 0]
    order = np.argsort(ranks, kind="stable")
    inside, ranks = inside[order], ranks[order]
    cuts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
    index = {rank: inside[a:b].tolist() for rank, a, b in zip(
        ranks[cuts].tolist(), cuts, [*cuts[1:], len(ranks)])}

    small = n <= IN_LISTS
    symbol, after, before = (x.tolist() if small else array("i", x.tolist())
                             for x in (symbols, after, before))
    rank_of, parts = vocabulary.rank.get, vocabulary.parts
    active = list(index)
    heapify(active)
    while active:
        rank = heappop(active)
        left, right, made = parts[rank]
        for at in sorted(index.pop(rank)):
            to = after[at]
            if symbol[at] != left or to < 0 or symbol[to] != right:
                continue  # this occurrence has merged into another pair
            symbol[at], symbol[to] = made, -1
            beyond = after[at] = after[to]
            if beyond >= 0:
                before[beyond] = at
                fresh = rank_of((made, symbol[beyond]))
                if fresh is not None:
                    if fresh in index:
                        index[fresh].append(at)
                    else:
                        index[fresh] = [at]
                        heappush(active, fresh)
            back = before[at]
            if back >= 0:
                fresh = rank_of((symbol[back], made))
                if fresh is not None:
                    if fresh in index:
                        index[fresh].append(back)
                    else:
                        index[fresh] = [back]
                        heappush(active, fresh)
    left_over = np.array(symbol, np.int32)
    alive = np.flatnonzero(left_over >= 0)
    return left_over[alive], np.diff(np.searchsorted(alive, ends), prepend=0)


class Known(dict):
    """Numbers of pre-tokens and special strings, and their ids as ``ids[start:start + size]``
    by number. A new string gets the next number and is listed as ``fresh``."""

    def __init__(self, special: dict[str, int]):
        super().__init__(zip(special, range(len(special))))
        self.ids = np.array(list(special.values()), np.int32)
        self.sizes = np.ones(len(special), np.int64)
        self.fresh: list[str] = []
        self.letters = 0

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self)
        self.fresh.append(token)
        return number


def encode(vocabulary: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes): ids of the texts one after another, and how many each has."""
    pre = regex.compile(PRE_TOKEN)
    special = regex.compile("(" + "|".join(
        regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True)) + ")"
        if vocabulary.special else "(?!)")
    if vocabulary.known is None:
        vocabulary.known = Known(vocabulary.special)
    known = vocabulary.known
    pieces, counts = [], []
    for text in texts:
        cut = special.split(text)  # special strings stand at the odd places
        own = pre.findall(text) if len(cut) == 1 else list(chain.from_iterable(
            [part] if i % 2 else pre.findall(part) for i, part in enumerate(cut)))
        pieces.append(own)
        counts.append(len(own))
    number = np.fromiter(map(known.__getitem__, chain.from_iterable(pieces)), np.int64, sum(counts))
    fresh, known.fresh = known.fresh, []
    ids, sizes = known.ids, known.sizes
    if fresh:
        new_ids, new_sizes = merged(vocabulary, [t.encode("utf-8") for t in fresh])
        ids, sizes = np.concatenate([ids, new_ids]), np.concatenate([sizes, new_sizes])
        letters = known.letters + sum(map(len, fresh))
        if letters <= REMEMBERED:
            known.ids, known.sizes, known.letters = ids, sizes, letters
        else:
            for token in fresh:
                del known[token]
    own = sizes[number]
    ends = np.cumsum(own)
    # Places of all ids: of each piece the start in ``ids``, and counting on from there.
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat((np.cumsum(sizes) - sizes)[number] - ends + own, own)
    by_text = np.diff(np.append(0, ends)[np.cumsum(counts)], prepend=0) if counts else np.zeros(0, np.int64)
    return ids[at], by_text


def encoded(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids) of every row: the whole text as ids of the vocabulary.

    ``vocabulary`` is the path of a byte-level BPE file, read by the driver alone; a file
    that is not plainly of this kind, or whose merges are not in the order of their making,
    is an error. Special strings inside a text are their special ids. A null text is empty;
    an empty one has no ids. Repeated rows and rows without id are encoded each; an empty
    table gives an empty result.
    """
    rows = pick(documents, "doc_id", "text")
    # Of fixed size: the vocabulary, whatever the documents are.
    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))
    schema = with_fields(rows.select("doc_id"), "ids array<int>")

    def scan(batches):
        for part in slices(batches):
            ids, sizes = encode(shared.value, [t.decode("utf-8", "replace") for t in utf8(part)])
            ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))],
                ["doc_id", "ids"])

    return rows.transform(map_arrow, scan, schema)


def decoded(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """The rows (doc_id, ids) and behind them ``text``: the bytes of the ids, special ones
    included, read as UTF-8 with U+FFFD for what is none. Ids outside the vocabulary and null
    ids stand for nothing; null lists give an empty text."""
    rows = pick(tokens, "doc_id", "ids").select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary).bytes_of)
    schema = with_fields(rows, "text string")

    def decode(batches):
        bytes_of = shared.value
        lengths = np.array([*map(len, bytes_of), 0], np.int64)
        for batch in batches:
            counts = batch.column("ids").value_lengths().fill_null(0).to_numpy()
            start, ends = 0, np.cumsum(counts)
            while start < batch.num_rows:
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + IDS, "right")))
                part = batch.slice(start, stop - start)
                ids = part.column("ids").flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                known = np.where((ids >= 0) & (ids < len(bytes_of)), ids, len(bytes_of))
                cuts = np.cumsum(np.append(0, lengths[known]))[np.append(0, np.cumsum(counts[start:stop]))]
                table = [*bytes_of, b""]
                joined = b"".join(map(table.__getitem__, known.tolist()))
                texts = [joined[a:b].decode("utf-8", "replace")
                         for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                                 ["doc_id", "ids", "text"])
                start = stop

    return rows.transform(map_arrow, decode, schema)


def round_trip(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: digests of the decimal ids
    joined by commas and of the text that they decode to."""
    both = decoded(encoded(documents, vocabulary), vocabulary)
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))
