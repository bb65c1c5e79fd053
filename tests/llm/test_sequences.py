"""Encoding, phrase mining and periodic runs against the library and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayrate.llm import bpe, periods, phrases, queries
from stayrate.llm.common import pick
from tests.llm.test_operators import documents, odd_rows, prose


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


# --- encoding and decoding ----------------------------------------------------------------

@pytest.fixture(scope="module")
def path():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def library_row(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_round_trip_agrees_with_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op11_bpe(spark, sf_dir).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: library_row(library, t) for i, t in texts.items()}


def test_encoding_of_hard_texts(path, library, monkeypatch):
    rng = random.Random(3)
    vocabulary = bpe.Vocabulary(path)
    texts = ["", "a", "\n\n x<|endoftext|>y<|endoftext|><|endoftext|>", "a" * 3000, "ab" * 900, "\u0000�😀漢字",
             "it's we'll \t don't", " " * 70, "<|endoftext|"]
    texts += ["".join(rng.choice("aabcdeé \n'sth漢<|endof>12") for _ in range(rng.randrange(60)))
              for _ in range(500)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for remembered, lists in ((1 << 22, 1 << 22), (300, 10)):  # the second time little is known
        monkeypatch.setattr(bpe, "REMEMBERED", remembered)
        monkeypatch.setattr(bpe, "IN_LISTS", lists)
        for k in (0, 200):  # what the first texts taught serves the others
            ids, sizes = bpe.encode(vocabulary, texts[k:])
            assert [a.tolist() for a in np.split(ids, np.cumsum(sizes)[:-1])] == want[k:]
        vocabulary.known = None
    assert bpe.encode(vocabulary, [])[1].tolist() == []


def test_decoding_of_any_ids(spark, path, library):
    rng = random.Random(4)
    lists = [[rng.randrange(50_257) for _ in range(rng.randrange(15))] for _ in range(200)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in enumerate(lists)], "doc_id bigint, ids array<int>, IDS string")
    got = {r.doc_id: r.text for r in bpe.decoded(frame, path).collect()}
    assert got == {i: library.decode(v, skip_special_tokens=False) for i, v in enumerate(lists)}
    odd = spark.createDataFrame([(1, None), (2, [64, None, -1, 99_999_999, 65]), (None, [])],
                                "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decoded(odd, path).collect()} == {1: "", 2: "ab", None: ""}


def test_merges_out_of_order_are_refused(tmp_path, path):
    import json
    model = json.loads(open(path, encoding="utf-8").read())
    model["model"]["merges"] = model["model"]["merges"][::-1]
    (tmp_path / "odd.json").write_text(json.dumps(model))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "odd.json"))


def test_bpe_odd_rows(spark, path, library):
    rows = odd_rows() + [(8, "a<|endoftext|>b"), (9, "x" * 100_000)]
    got = bpe.round_trip(documents(spark, rows), path).collect()
    want = [(i, *library_row(library, t)) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.round_trip(documents(spark, []), path).count() == 0


# --- phrases ------------------------------------------------------------------------------

def plain_phrases(rows, least=30, covered=80, top=2000):
    pieces = [(lang or "und", [w for w in re.split(r"[ \t]+", p) if w]) for lang, text in rows
              for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if c.isascii() else c for c in text or ""))]
    f, total = Counter(), Counter()
    for lang, w in pieces:
        total[lang] += len(w)
        f.update((lang, tuple(w[i:i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = []
    for lang in total:
        left = []
        for (own, p), a in found.items():
            if own != lang or any(o == lang and len(q) > len(p) and 100 * b >= covered * a
                                  and any(q[i:i + len(p)] == p for i in range(len(q)))
                                  for (o, q), b in found.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]],
                                  f[lang, p[k:]]) for k in range(1, len(p)))
            left.append((-score, -a, " ".join(p).encode(), l, r))
        left.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s)
                for i, (s, a, p, l, r) in enumerate(left[:top])]
    return sorted(out)


def phrase_rows(spark, rows):
    data = [(i, t, lang, "x", 1) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, TEXT string, n bigint")


def hot_rows(seed):
    """Texts of few words: ties, overlaps, one very frequent pair, signs and control letters."""
    rng = random.Random(seed)
    words = ["a", "b", "A", "c\u0001", "c", "é", "\u0002", "dd"]
    rows = []
    for _ in range(150):
        lang = rng.choice(["en", "en", "en", None, "und", "x\ty", "x"])
        rows.append((lang, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", "\n", "  ", "."])
                                   for _ in range(rng.randrange(40)))))
    return rows + [("en", "hot pair " * 700), ("en", None), (None, ""), ("de", " ,.;"), ("x\ty", "b a " * 60)]


@pytest.mark.parametrize("budget", [1 << 18, 200, 10])
def test_phrases_agree_with_brute_force(spark, monkeypatch, budget):
    monkeypatch.setattr(phrases.borders, "__defaults__", (budget,))
    monkeypatch.setattr(phrases, "PORTION", 500)
    rows = hot_rows(budget)
    for least, top in ((30, 2000), (12, 5)):
        got = phrases.collocations(phrase_rows(spark, rows), least=least, top=top).collect()
        assert sorted(map(tuple, got)) == plain_phrases(rows, least, top=top)


def test_heavy_prefixes_are_lengthened(spark):
    rows = phrase_rows(spark, [("en", "hot pair one hot pair two " * 100), ("en", "cold " * 5 + "last " * 40)])
    rows = pick(rows, "lang", "text")
    words = phrases.word_counts(rows)
    bits = spark.sparkContext.broadcast(phrases.frequent_bits(words))
    starts = phrases.borders(rows, words, bits, 90)
    assert starts == sorted(starts) and max(k.count(b"\t") for k in starts) > 2
    assert len(phrases.borders(rows, words, bits, 10_000)) <= 8  # one for each partition
    total = phrases.leaves(rows, spark.sparkContext.broadcast(starts), bits)
    sizes = {r.group: r.n for r in total.select("group", F.explode("counts").alias("n")).groupBy("group")
             .agg(F.sum("n").alias("n")).collect()}
    assert sum(sizes.values()) == 645 and len(sizes) > 4


def test_subtree_totals():
    rng = np.random.default_rng(1)
    found = rng.integers(0, 4, (300, 4))
    found[:, 0] += 1
    found = np.where(np.cumsum(found == 0, axis=1) > 0, 0, found)
    n = rng.integers(1, 5, 300)
    for d, (at, total) in enumerate(phrases.subtree(found, n), 1):
        want = Counter()
        for row, c in zip(found.tolist(), n.tolist()):
            if row[d - 1]:
                want[tuple(row[:d])] += c
        assert {tuple(found[i, :d].tolist()): t for i, t in zip(at, total.tolist())} == want


def test_phrases_of_no_rows(spark):
    assert phrases.collocations(phrase_rows(spark, [])).count() == 0
    assert phrases.collocations(phrase_rows(spark, [("en", None), (None, "a b c")])).count() == 0


# --- periodic runs ------------------------------------------------------------------------

def plain_runs(words):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q) and j > i:
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def sequences(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        n, k = rng.randrange(90), rng.choice([1, 2, 3, 5, 50])
        words = [rng.randrange(k) for _ in range(n)]
        kind = rng.randrange(3)
        if n and kind == 0:
            a = rng.randrange(n)
            p = 1 + rng.randrange(1 + (n - a) // 2)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        elif kind == 1:
            x, words = [0], [0, 1]
            while len(words) < n:
                x, words = words, words + x
        yield np.array(words[:n], np.int64)


def test_runs_agree_with_brute_force():
    for seed in range(40):
        own = list(sequences(seed, 8))
        assert [[tuple(r) for r in found.tolist()] for found in periods.runs_of(own)] == [
            plain_runs(s.tolist()) for s in own]


def test_grammar_extends_exactly():
    words = np.concatenate([[9], next(sequences(3, 1)), [10], np.tile([1, 2, 2, 1], 30), [11]])
    marks = [i for i, w in enumerate(words) if w >= 9]
    grammar = periods.Grammar(words, 9)
    rng = random.Random(6)
    for low, high in zip(marks, marks[1:]):
        pairs = [tuple(rng.sample(range(low + 1, high), 2)) for _ in range(300 if high - low > 2 else 0)]
        for step, end in ((1, high), (-1, low)):
            got = grammar.extend(*(np.array(x, np.int64) for x in zip(*pairs)), step) if pairs else []
            for (a, b), n in zip(pairs, got):
                want = 0
                while end not in (a + step * want, b + step * want) and words[a + step * want] == words[b + step * want]:
                    want += 1
                assert n == want


def test_periods_agree_with_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(200), rng.choice([2, 30, 4000]))) for i in range(300)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10
    got = periods.run_table(documents(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_row(i, t) for i, t in rows)


def test_periods_query_agrees_with_brute_force(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in queries.op13_periods(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    short = [(r.doc_id, r.text) for r in texts if len((r.text or "").split()) < 1500]
    assert len(short) > 100
    assert [got[i] for i, _ in short] == [plain_row(i, t) for i, t in short]


def test_periods_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] != 7] + [(7, "word " * 3000), (8, "x y " * 6), (8, "x y " * 6), (9, "x y " * 5)]
    got = sorted(map(tuple, periods.run_table(documents(spark, rows)).collect()), key=str)
    assert got == sorted((plain_row(i, t) if i != 7 else
                          (7, 1, 0, 3000, 1, 3_000_000, sha("0,3000,1\n"), sha("word")) for i, t in rows), key=str)
    assert periods.run_table(documents(spark, [])).count() == 0
