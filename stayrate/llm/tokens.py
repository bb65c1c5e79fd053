"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Texts are cut into pre-tokens; the distinct pre-tokens of a batch lie in one ragged numpy
array of symbols. In every round each sequence finds its pair of lowest rank and merges
all its occurrences at once, whichever pair that is in the other sequences; sequences
without a known pair leave with their number of symbols.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import map_arrow, pick, slices, utf8, with_fields

# Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1 << 40)
# Pre-tokens whose counts a worker remembers, and the longest that is remembered.
REMEMBERED, LONGEST = 400_000, 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such a vocabulary: itself where printable,
    else the next free letter from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """The merge table as arrays: sorted pair keys, their ranks, and the symbol of each rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        pre = model.get("pre_tokenizer") or {}
        if (model["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel"
                or pre.get("add_prefix_space") or model.get("normalizer")
                or not pre.get("use_regex", True) or model["model"].get("ignore_merges")):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        vocab = model["model"]["vocab"]
        self.width = max(vocab.values()) + 1
        self.bytes = np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            self.bytes[byte] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.special = [t["content"] for t in model.get("added_tokens", [])]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty byte string after all merges."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = sizes.copy()
        symbol = self.bytes[np.frombuffer(b"".join(tokens), np.uint8)]
        ids = np.arange(len(tokens))
        if not len(symbol):
            return out
        rank = np.full(len(symbol), NONE)
        rank[:-1] = self.rank(symbol[:-1], symbol[1:])
        rank[np.cumsum(sizes) - 1] = NONE
        while True:
            starts = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat(rank, starts)
            going = low < NONE
            if not going.all():
                out[ids[~going]] = sizes[~going]
                keep = np.repeat(going, sizes)
                symbol, rank = symbol[keep], rank[keep]
                sizes, ids, low = sizes[going], ids[going], low[going]
            if not len(ids):
                return out
            hit = np.flatnonzero(rank == np.repeat(low, sizes))
            # In a run of overlapping hits (x x x) every second one merges, from the left.
            first = np.ones(len(hit), bool)
            first[1:] = np.diff(hit) > 1
            run = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            owner = np.searchsorted(np.cumsum(sizes), hit, "right")
            sizes = sizes - np.bincount(owner, minlength=len(sizes))
            rank[hit] = rank[hit + 1]  # keeps the mark at a sequence's end
            symbol, rank = symbol[stay], rank[stay]
            now = hit - np.arange(len(hit))
            ends = np.cumsum(sizes) - 1
            stale = np.union1d(now, np.setdiff1d(now[now > 0] - 1, ends))
            stale = np.setdiff1d(stale, ends)
            rank[stale] = self.rank(symbol[stale], symbol[stale + 1])
            rank[ends] = NONE


def counter(merges: Merges):
    """A function from texts to token counts that remembers frequent pre-tokens."""
    pre = regex.compile(PRE_TOKEN)
    special = regex.compile("|".join(
        regex.escape(s) for s in sorted(merges.special, key=len, reverse=True)) or r"(?!)")
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        pieces, extra = [], []
        for text in texts:
            found = special.findall(text)
            extra.append(len(found))
            pieces.append(list(chain.from_iterable(map(pre.findall, special.split(text))))
                          if found else pre.findall(text))
        fresh = [t for t in set(chain.from_iterable(pieces)) if t not in known]
        known.update(zip(fresh, merges.count([t.encode("utf-8") for t in fresh]).tolist()))
        out = [n + sum(map(known.__getitem__, p)) for n, p in zip(extra, pieces)]
        if len(known) > REMEMBERED:
            known.clear()
        else:
            for token in fresh:
                if len(token) > LONGEST:
                    del known[token]
        return out

    return count


def token_counts(documents: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    ``vocabulary`` is the path of a byte-level BPE file, read by the driver alone. Special
    strings inside a text count as one token each. A null text is empty and has no tokens.
    Repeated rows are counted each; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    merges = spark.sparkContext.broadcast(Merges(vocabulary))  # the size of the vocabulary
    rows = pick(documents, "doc_id", "text")
    schema = with_fields(rows.select("doc_id"), "n_bytes bigint, n_tokens bigint")

    def count(batches):
        counts = counter(merges.value)
        for part in slices(batches):
            texts = utf8(part)
            tokens = counts([t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return rows.transform(map_arrow, count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
