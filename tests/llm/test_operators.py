"""The training-data operators against brute force and fixed cases."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as contract
from stayrate.llm import (common, components, decontaminate, embeddings, licenses, mixing, quality,
                          queries, sharding, simhash, substrings, tokens, toxicity)
from tests.compare import difference, duck

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, TEXT string, shard int"


def documents(spark, rows, sources=None):
    """Rows (doc_id, text) with the other columns, and two whose names clash."""
    data = [(i, t, "en", (sources or {}).get(i, "s1"), None, "x", 7) for i, t in rows]
    return spark.createDataFrame(data, EXTRA)


def odd_rows():
    """Null and empty values, white space alone, ties, repeats and a very long text."""
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one two three four"), (4, "one two three four"),
            (5, "one two three four"), (None, "one two three four"), (None, None),
            (6, "Ünï code ’quoted’ 123"), (7, "word " * 40_000)]


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return [(r.doc_id, r.text) for r in
            spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.STATEMENTS))
def test_statements(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.STATEMENTS[name]) is None


def test_all_registered():
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())


# --- near-duplicates by fingerprint -----------------------------------------------------

def plain_fingerprint(text):
    words = SPACE.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_simhash_agrees_with_brute_force(spark, sf_dir, corpus):
    want = {i: plain_fingerprint(t) for i, t in corpus}
    pairs = [(a, b) for a in want for b in want if a < b and bin(want[a] ^ want[b]).count("1") <= 3]
    root = plain_components(want, pairs)
    assert len(set(root.values())) < len(root)
    rows = queries.op1_simhash(spark, sf_dir).collect()
    assert len(rows) == len(corpus)
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in rows} == {
        i: (want[i], root[i]) for i in want}


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_near_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (200, 4)).astype(np.uint64))
    near = base[rng.integers(0, 40, 200)] ^ np.bitwise_xor.reduce(flips, axis=1)
    left, right = np.concatenate([base, near[:50]]), near
    i, j = simhash.near_pairs(left, right, radius)
    want = {(a, b) for a in range(len(left)) for b in range(len(right))
            if bin(int(left[a]) ^ int(right[b])).count("1") <= radius}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_simhash_links_over_split_buckets(spark):
    rng = random.Random(5)
    base = rng.getrandbits(62)
    fps = sorted({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)})
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    found = components.components(simhash.links(frame, 3, chunk=16)).collect()
    linked = [(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3]
    want = plain_components(fps, linked)
    got = {f: f for f in fps} | {r.node: r.root for r in found}
    assert got == want


def test_simhash_odd_rows(spark):
    rows = simhash.near_duplicates(documents(spark, odd_rows())).collect()
    assert len(rows) == len(odd_rows())
    by_id = {r.doc_id: r.component_id for r in rows if r.doc_id}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[4] == by_id[5] == 4
    assert {r.component_id for r in rows if r.doc_id is None} == {1, 4}
    kept = simhash.kept_documents(documents(spark, odd_rows()))
    assert kept.columns == EXTRA.replace(" bigint", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted(r[0] for r in kept.collect()) == [1, 4, 6, 7]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_rows_without_id_and_repeated_ids_are_kept_by_row(spark):
    rng = random.Random(12)
    text, other, lone = prose(rng, 400), prose(rng, 400), prose(rng, 400)
    near = text.rsplit(" ", 1)[0] + " end"
    # A group without any id stands beside rows without id that are copies of kept ones.
    rows = [(None, lone), (1, text), (None, near), (None, text), (2, other), (2, text), (2, other),
            (None, lone)]
    want = sorted([(1, text), (2, other), (None, lone)], key=str)
    assert sorted([(r[0], r[1]) for r in simhash.kept_documents(documents(spark, rows)).collect()],
                  key=str) == want


# --- components ---------------------------------------------------------------------------

def test_dropping_near_copies_shuffles_no_texts(spark):
    """Whatever the threshold for broadcasts: digests go to the documents, up to MOST_SENT."""
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(i, words) for i in range(6)] + [(1, words)] + [(10, "some other words here")] * 2
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = simhash.kept_documents(documents(spark, rows))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(r[0] for r in out.collect()) == [0, 10]
        few = simhash.MOST_SENT
        simhash.MOST_SENT = 0
        try:
            assert sorted(r[0] for r in simhash.kept_documents(documents(spark, rows)).collect()) == [0, 10]
        finally:
            simhash.MOST_SENT = few
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1100)]
    loose = [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    edges = chain + star + loose + chain[:5] + [(b, a) for a, b in star[:5]]
    want = plain_components({x for e in edges for x in e}, edges)
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    got = {n: n for n in want} | {r.node: r.root for r in found}
    assert got == want


# --- substrings ---------------------------------------------------------------------------

def test_passages_found_and_clean_left_alone(spark):
    rng = random.Random(3)
    shared, fuzzy = prose(rng, 55), prose(rng, 120).split()
    changed = [w if i % 25 else "changed" for i, w in enumerate(fuzzy)]
    rows = [(1, prose(rng, 200) + " " + shared + " " + prose(rng, 30)),
            (2, prose(rng, 10) + " " + shared.upper()),
            (3, prose(rng, 90) + " " + shared + " " + prose(rng, 400)),
            (4, prose(rng, 40) + " " + " ".join(fuzzy)), (5, " ".join(changed) + " " + prose(rng, 60)),
            (6, prose(rng, 300)), (7, prose(rng, 300)), (8, " ".join(shared.split()[:40])),
            (9, rows_text := prose(rng, 80)), (10, rows_text)]
    found = {(r.doc_id, r.ref_doc_id): r for r in substrings.passages(documents(spark, rows)).collect()}
    assert set(found) == {(2, 1), (3, 1), (5, 4), (10, 9)}
    one = found[3, 1]
    assert one.start_word <= 90 and one.end_word >= 145 and one.n_words <= 60 and one.identity > 0.9
    assert (one.ref_start, one.ref_end) == (200, 255) or one.n_words >= 55
    assert found[5, 4].n_words > 90 and 0.9 < found[5, 4].identity < 1
    assert (found[10, 9].start_word, found[10, 9].end_word, found[10, 9].identity) == (0, 80, 1.0)


def test_chains_are_the_best():
    rng = random.Random(11)
    for _ in range(30):
        points = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(25)})
        at, ref = np.array([p[0] for p in points]), np.array([p[1] for p in points])
        best = [substrings.GAIN] * len(points)
        for i, (a, b) in enumerate(points):
            for j, (c, d) in enumerate(points[:i]):
                if c < a and d < b:
                    best[i] = max(best[i], substrings.GAIN + best[j]
                                  - substrings.COST * (a - c + b - d))
        chain = substrings.chains_of(at, ref)[0]
        steps = [(points[i], points[j]) for i, j in zip(chain, chain[1:])]
        score = substrings.GAIN * len(chain) - substrings.COST * sum(
            a2 - a + b2 - b for (a, b), (a2, b2) in steps)
        assert all(a < a2 and b < b2 for (a, b), (a2, b2) in steps)
        assert score == pytest.approx(max(best))


def test_common_words():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = rng.integers(0, 5, rng.integers(0, 12)), rng.integers(0, 5, rng.integers(0, 12))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert substrings.common_words(a, b) == table[-1, -1]


def test_chain_over_two_passages_is_cut_at_its_gap(spark):
    first, second = [f"a{i}" for i in range(90)], [f"b{i}" for i in range(90)]
    rows = [(1, " ".join(first + [f"x{i}" for i in range(70)] + second)),
            (2, " ".join(first + [f"y{i}" for i in range(70)] + second))]
    found = sorted((r.start_word, r.end_word, r.ref_start, r.ref_end, r.identity)
                   for r in substrings.passages(documents(spark, rows)).collect())
    assert found == [(0, 90, 0, 90, 1.0), (160, 250, 160, 250, 1.0)]


def test_passage_whose_seeds_an_earlier_text_holds_in_part(spark):
    passage = [f"p{i}" for i in range(120)]
    rows = [(1, " ".join([f"u{i}" for i in range(60)] + passage[:45])), (2, " ".join(passage)),
            (3, " ".join([f"v{i}" for i in range(30)] + passage))]
    found = {(r.doc_id, r.ref_doc_id): (r.start_word, r.end_word)
             for r in substrings.passages(documents(spark, rows)).collect()}
    assert found == {(3, 2): (30, 150)}


def test_substrings_odd_rows(spark):
    assert substrings.passages(documents(spark, odd_rows())).count() == 0
    assert substrings.passages(documents(spark, [])).count() == 0
    repeated = [(7, "word " * 4000), (8, "word " * 4000), (8, "word " * 4000), (None, "word " * 4000),
                (9, "word " * 49)]
    assert [tuple(r) for r in substrings.passages(documents(spark, repeated)).collect()] == [
        (8, 0, 4000, 7, 0, 4000, 4000, 1.0)]


def test_copies_of_one_repeated_line(spark):
    rng = random.Random(41)
    line = prose(rng, 12) + "\n"
    rows = [(1, line * 20), (2, line * 20), (3, prose(rng, 70) + " " + line * 30 + prose(rng, 40)),
            (4, line * 4), (5, prose(rng, 30) + " " + line * 6)]
    found = {(r.doc_id, r.start_word, r.end_word) for r in substrings.passages(documents(spark, rows)).collect()}
    assert (2, 0, 240) in found and (5, 30, 102) in found
    assert any(d == 3 and a <= 82 and b >= 290 for d, a, b in found) and not any(d == 4 for d, _, _ in found)


def test_passage_of_lines_that_other_texts_hold(spark):
    rng = random.Random(42)
    one, two, three = (prose(rng, 25) for _ in range(3))
    rows = [(1, prose(rng, 40) + " " + one + " " + prose(rng, 40)), (2, two + " " + prose(rng, 60)),
            (3, prose(rng, 50) + " " + three), (4, one + " " + two + " " + three + " " + prose(rng, 20)),
            (5, prose(rng, 33) + " " + two), (6, prose(rng, 31) + " " + one + " " + three + " " + prose(rng, 9)),
            (7, prose(rng, 30) + " " + one + " " + two + " " + three)]
    found = {(r.doc_id, r.ref_doc_id): (r.start_word, r.end_word, r.identity)
             for r in substrings.passages(documents(spark, rows)).collect()}
    assert found == {(7, 4): (30, 105, 1.0)}


def test_passage_all_of_whose_seeds_have_other_holders(spark):
    """Every seed of the passage that rows 40 and 80 share has its first and its nearest earlier
    holder among rows that have 30 words of it."""
    rng = random.Random(45)
    words = prose(rng, 60).split()
    pieces = [words[a:a + 30] for a in (0, 8, 15, 23, 30)]
    rows = [(i, f"{prose(rng, 45)} {' '.join(pieces[i % 5])} {prose(rng, 45)}") for i in range(100)]
    rows[40] = 40, f"{prose(rng, 30)} {' '.join(words)} {prose(rng, 30)}"
    rows[80] = 80, f"{prose(rng, 33)} {' '.join(words[:31] + ['other'] + words[32:])} {prose(rng, 20)}"
    found = [tuple(r) for r in substrings.passages(documents(spark, rows)).collect()]
    assert found == [(80, 33, 93, 40, 30, 90, 60, 59 / 60)]


def test_alike_rows_against_plain_counts(monkeypatch):
    """Surroundings are told apart as by counting their equal pairs, in one cell or in several."""
    rng = np.random.default_rng(46)
    base = rng.integers(0, 40, (6, 300))
    texts = [np.where(rng.random(300) < rng.choice([0.05, 0.2, 0.5]), rng.integers(0, 40, 300), base[rng.integers(6)])
             for _ in range(60)]
    for t in texts:
        t[140:145] = 7
    at, name, place = np.array([140]), np.array([3]), np.arange(60)
    seen = np.concatenate([substrings.surroundings(t.astype(np.uint16), at, name, [(0, 300)] if k % 3 else [])
                           for k, t in enumerate(texts)])
    assert seen["loose"].tolist() == [k % 3 == 0 for k in range(60)]
    low, high = 140 - substrings.REACH, 145 + substrings.REACH
    middle = substrings.REACH + substrings.K // 2
    counts = [Counter((a - low < middle, *t[a:a + 2].tolist()) for a in range(low, high - 1)) for t in texts]
    want = {(i, j) for i in range(0, 60, 3) for j in range(i)
            if sum((counts[i] & counts[j]).values()) >= substrings.COMMON}
    monkeypatch.setattr(substrings, "PAIRS", 50)
    got = substrings.alike_rows(place, seen)
    assert want and set(zip(*got.tolist())) == want
    parts = [substrings.alike_rows(place[:30], seen[:30])]
    parts += [substrings.alike_rows(place[30:], seen[30:]), substrings.alike_rows(place, seen, 30)]
    assert set(zip(*np.concatenate(parts, axis=1).tolist())) == want


def changed_words(rng, words, share, kinds):
    out = words[:]
    for at in sorted(rng.sample(range(len(words)), round(len(words) * share)), reverse=True):
        kind = rng.choice(kinds)
        if kind == "less":
            del out[at]
        else:
            out[at:at + (kind == "other")] = [f"x{rng.randrange(10 ** 6)}"]
    return out


def test_fuzzy_passages_against_brute_force(spark):
    """Planted passages of 50 to 120 words at identity 0.8 to 0.95 are found at 0.9 at least, and
    whatever is found is as alike as it says by the whole alignment table."""
    rng = random.Random(43)
    rows, planted = [], {}
    for length in (50, 60, 80, 120):
        for share in (0.05, 0.1, 0.15, 0.2):
            for kinds in (["other"], ["other", "more", "less"]):
                for _ in range(12):
                    i, words = len(rows), prose(rng, length).split()
                    other = changed_words(rng, words, share, kinds)
                    before = prose(rng, rng.randrange(100))
                    rows += [(i, f"{prose(rng, rng.randrange(90))} {' '.join(words)} {prose(rng, rng.randrange(90))}"),
                             (i + 1, f"{before} {' '.join(other)} {prose(rng, rng.randrange(90))}")]
                    planted[i + 1] = (i, len(before.split()), len(before.split()) + len(other))
    rows += [(len(rows) + k, prose(rng, 150)) for k in range(60)]
    words = {i: t.split() for i, t in rows}
    found = substrings.passages(documents(spark, rows)).collect()
    hit = set()
    for r in found:
        assert r.doc_id in planted and r.ref_doc_id == planted[r.doc_id][0]
        _, start, end = planted[r.doc_id]
        hit |= {r.doc_id} if min(end, r.end_word) - max(start, r.start_word) >= 0.7 * (end - start) else set()
        own, other = words[r.doc_id][r.start_word:r.end_word], words[r.ref_doc_id][r.ref_start:r.ref_end]
        table = np.zeros((len(own) + 1, len(other) + 1), int)
        for i, x in enumerate(own):
            for j, y in enumerate(other):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        n = max(len(own), len(other))
        assert r.n_words == len(own) and n >= substrings.CORE and table[-1, -1] >= r.identity * n - 1e-9
        assert r.identity >= substrings.IDENTITY
    assert len(hit) >= 0.9 * len(planted)


def test_grown_is_the_best_beginning():
    rng = random.Random(44)
    for _ in range(60):
        a = [rng.randrange(500) for _ in range(30)]
        b = [int(x) if not str(x).startswith("x") else 1000 + k for k, x in enumerate(changed_words(
            rng, a, rng.choice([0.05, 0.15]), ["other", "more", "less"]))]
        best = {(0, 0): (0, 0)}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                steps = [best[x] for x in ((i - 1, j), (i, j - 1)) if x in best]
                values = [v[0] - substrings.DIFFERENCE for v in steps]
                if (i - 1, j - 1) in best:
                    same = a[i - 1] == b[j - 1]
                    values.append(best[i - 1, j - 1][0] + (1 if same else -substrings.DIFFERENCE))
                if values:
                    best[i, j] = (max(values), 0)
        x, y, same = substrings.grown(np.array(a, np.uint16), np.array(b, np.uint16))
        top = max(v[0] for v in best.values())
        assert best[x, y][0] == top and same <= min(x, y)


def test_first_and_nearest_holders():
    rng = np.random.default_rng(3)
    key, row = rng.integers(0, 12, 80).astype(np.uint64), np.sort(rng.integers(0, 9, 80))
    later, earlier, leading = substrings.paired(key, row, np.argsort(key, kind="stable"))
    want = set()
    for i in range(80):
        before = [j for j in range(80) if key[j] == key[i] and row[j] < row[i]]
        if before:
            near = max(row[j] for j in before)
            want |= {(i, before[0]), (i, min(j for j in before if row[j] == near))}
        assert (i in leading.tolist()) == (not before)
    assert set(zip(later.tolist(), earlier.tolist())) == want and len(later) == len(want)


# --- embeddings ---------------------------------------------------------------------------

def test_embeddings_agree_with_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 24))
    near = base[rng.integers(0, 150, 200)] + 0.07 * rng.standard_normal((200, 24))
    vectors = np.concatenate([base, near, base[:20], 3 * base[20:30]])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosine = unit @ unit.T
    linked = [(i, j) for i in range(len(unit)) for j in range(i) if cosine[i, j] >= 0.9]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame, 0.9).collect()}
    links = np.zeros(len(unit), int)
    for i, j in linked:
        links[i] += 1
        links[j] += 1
    assert sum(r.n_links for r in got.values()) >= 0.98 * links.sum()
    assert all(got[i].n_links <= links[i] for i in got)
    root = plain_components(range(len(unit)), linked)
    assert sum(got[i].component_id == root[i] for i in got) >= 0.97 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embedding_links_over_split_buckets(spark):
    rng = np.random.default_rng(8)
    vectors = np.ones(16) + 0.02 * rng.standard_normal((90, 16))
    frame = spark.createDataFrame([(i, 2, v.tolist()) for i, v in enumerate(vectors)],
                                  "id bigint, n bigint, vector array<double>")
    found = embeddings.near_links(frame, 0.9, chunk=8).groupBy("a").sum("n").collect()
    assert sorted(r[1] for r in found) == [2 * 89] * 90  # every pair once, n vectors each


def test_embeddings_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0]), (9, [1.0, 1.0]), (None, [1.0, 1.0]),
            (10, [1.0, 1.0, 1.0]), (11, [3e38, 3e38])]
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows],
                                  "vec_id bigint, embedding array<float>, label int, Label string")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in
           embeddings.near_duplicates(frame).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r[0])) == [
        *[(i, 0, i, True) for i in range(1, 7)], (7, 4, 7, True), (8, 4, 7, False), (9, 4, 7, False),
        (9, 4, 7, False), (10, 0, 10, True), (11, 4, 7, False), (None, 0, None, False)]
    assert embeddings.near_duplicates(frame.where("false")).count() == 0


# --- tokens -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_tokens_agree_with_the_library(spark, sf_dir, corpus, library):
    rows = {r.doc_id: r for r in queries.op4_tokens(spark, sf_dir).collect()}
    want = library.encode_batch([t or "" for _, t in corpus], add_special_tokens=False)
    assert {i: (len((t or "").encode()), len(e.ids), len(e.ids) > 512) for (i, t), e in zip(corpus, want)
            } == {i: (r.n_bytes, r.n_tokens, r.over_limit) for i, r in rows.items()}


def test_tokens_of_hard_texts(library):
    import public_tokenizers
    rng = random.Random(9)
    letters = "ab cdeéß漢字  \n\t'sll're…—🙂 12 ½​ !?#xX"
    texts = ["", " ", "\n\n  x", "aaaaaaaaaaaaaaaa", "a" * 5001, "<|endoftext|>",
             "x<|endoftext|> <|endoftext|>y", "it's we'll THEY'RE", "ab" * 3000, "é ‍",
             *["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(800)]]
    count = tokens.counter(tokens.Merges(public_tokenizers.path("byte_bpe_50k.json")))
    got = count(texts[:300]) + count(texts[300:])
    assert got == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_tokens_odd_rows(spark):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = tokens.token_counts(documents(spark, odd_rows()), path).collect()
    assert sorted(r.n_tokens for r in rows if r.n_bytes == 0) == [0, 0, 0]
    assert len(rows) == len(odd_rows())
    assert tokens.token_counts(documents(spark, []), path).count() == 0


# --- classifiers --------------------------------------------------------------------------

def auc(score, truth):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    for v in np.unique(score):
        rank[score == v] = np.mean(np.flatnonzero(np.sort(score) == v)) + 1
    del order
    pos = truth == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("name,label,divisor,rest", [("op5_quality", "quality", 4, 2),
                                                     ("op6_toxicity", "toxic", 3, 1)])
def test_classifier_on_held_out_rows(spark, name, label, divisor, rest):
    sf_dir = "/root/testdata/sf0.1"
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == rest) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    y = np.array([truth[r.doc_id] for r in held])
    score = np.array([r.score for r in held])
    # Some toxic labels of this table stand on texts without any insult.
    assert auc(score, y) > (0.97 if name == "op5_quality" else 0.93)
    assert np.mean((score >= 0.7) == y) > 0.96


def test_classifiers_without_labels_and_with_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, None, "a"), (None, 1, 1, "b"), (4, 1, 0, "c"), (4, 0, 0, "d"),
                                 (7, 0, 1, "e"), (99, 1, 1, "f")],
                                "doc_id bigint, quality int, toxic int, Quality string")
    for table in (labels, odd):
        for score in (quality.score_table, toxicity.score_table):
            rows = score(documents(spark, odd_rows()), table).collect()
            assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
            assert score(documents(spark, []), table).count() == 0
    assert quality.accepted(documents(spark, odd_rows()), labels).count() == 0


def test_isotonic():
    x, y = quality.isotonic(np.array([0.1, 0.3, 0.2, 0.6]), np.array([1.0, 1, 0, 9]),
                            np.array([2.0, 2, 4, 10]))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all()
    assert y[0] == 0 and y[-1] == 1 and y.tolist()[1:3] == [1 / 6, 0.5]
    assert quality.isotonic(*np.zeros((3, 0)))[1].tolist() == [0, 1]


def test_grammar():
    go, out = toxicity.grammar()
    lexicon = toxicity.Lexicon({"lowei": toxicity.INSULT, "achl": toxicity.MILD})

    def found(text):
        return {n: c for n, c in zip(toxicity.PATTERNS, toxicity.patterns(text, lexicon, go, out)) if c}

    assert found("You are an idiot.") == {"insult_target": 1}
    assert found("An idiot. You are here.") == {"insult": 1}
    assert found("idiot, you") == {"insult_target": 1}
    assert found("That is not stupid at all") == {"spared_insult": 1}
    assert found("He said the plan is stupid") == {"spared_insult": 1}
    assert found("I will kill you") == {"threat_target": 1}
    assert found("They kill time") == {"threat_target": 1}
    assert found("ein loweiheit; ein Satz") == {"insult": 1}
    assert found("achlich und achlichung") == {"mild": 2, "mild_density": 3}
    assert found("not achlich") == {}
    assert found("clean words only") == {}


# --- mixing -------------------------------------------------------------------------------

def test_mix_near_targets(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(0, 60))) for i in range(600)]
    sources = {i: rng.choice(["a", "a", "a", "b", "c", None]) for i, _ in rows}
    got = mixing.mix(documents(spark, rows, sources), [3, 1, 2], 1.5, 2, 42).collect()
    size = {i: len(SPACE.findall(t)) for i, t in rows}
    assert {r.doc_id: r.size for r in got} == size
    caps = {s: 2 * sum(size[i] for i in sources if sources[i] == s) for s in set(sources.values())}
    weight = {"a": 3, "b": 1, "c": 2, None: 3}
    targets, budget, open_ = {}, 1.5 * sum(size.values()), set(caps)
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if caps[s] <= level * weight[s]}
        targets |= {s: caps[s] if full else level * weight[s] for s in full or open_}
        budget -= sum(caps[s] for s in full)
        open_ = open_ - full if full else set()
    for s in caps:
        own = [r for r in got if sources[r.doc_id] == s]
        assert own[0].target == pytest.approx(targets[s]) and 2 * own[0].source_size == caps[s]
        assert abs(sum(r.taken for r in own) - targets[s]) <= 1
        assert all(r.taken <= 2 * r.size for r in own)
    again = mixing.mix(documents(spark, rows[::-1], sources).repartition(5), [3, 1, 2], 1.5, 2, 42)
    assert sorted(again.collect()) == sorted(got)


def test_mix_odd_rows(spark):
    docs = documents(spark, odd_rows(), {1: None, 4: "s2", 7: None})
    got = mixing.mix(docs, [3, 1, 2], 1.5, 2, 42).collect()
    assert len(got) == len(odd_rows()) and all(r.taken <= 2 * r.size for r in got)
    out = mixing.mixed(docs, [3, 1, 2], 1.5, 2, 42)
    assert out.columns == docs.columns and out.where("doc_id in (1, 2, 3)").count() >= 3
    assert mixing.mix(documents(spark, []), [3, 1, 2], 1.5, 2, 42).count() == 0
    assert mixing.mixed(documents(spark, [(1, None), (2, "")]), [3], 1.5, 2, 42).count() == 2


# --- licences -----------------------------------------------------------------------------

def test_licenses(spark):
    mit = licenses.KNOWN[-1][1]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper()), (2, mit.replace("\n", "  ")),
            (3, "prose\nReleased   under the M.I.T. licence!\nmore"), (4, "Released under the MIT Licence."),
            (5, "prose that is Released under the MIT License. or not"),
            (6, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), *odd_rows()]
    rows[2] = (3, "prose\n* Released   under the MIT licence!\nmore")
    got = licenses.licenses(documents(spark, [(i and i + 100 if n > 5 else i, t) for n, (i, t) in
                                              enumerate(rows)]), licenses.registry(spark)).collect()
    by_id = {r.doc_id: (r.whole_license, r.licenses, r.n_units) for r in got}
    assert by_id[1] == by_id[2] == ("MIT", "MIT", 1) and by_id[4] == ("MIT", "MIT", 1)
    assert by_id[3] == (None, "MIT", 1) and by_id[5] == (None, "", 0)
    assert by_id[6] == (None, "CC-BY-NC-4.0,MIT", 2)
    assert all(v == (None, "", 0) for i, v in by_id.items() if i is None or i > 100)
    assert len(got) == len(rows)
    assert licenses.licenses(documents(spark, []), licenses.registry(spark)).count() == 0


def test_whole_standard_texts(spark):
    from pathlib import Path
    folder = Path(licenses.__file__).parent / "license_texts"
    texts = {p.stem: p.read_text(encoding="utf-8") for p in folder.glob("*.txt")}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause",
            "CC0-1.0"} <= set(texts)
    names = sorted(texts)
    # Other line breaks, letter case and a copyright line of its own make no difference.
    rows = [(n, "Copyright 2021 Someone\n" + texts[name].upper().replace(" ", "  "))
            for n, name in enumerate(names)]
    mit, isc = licenses.KNOWN[-1][1], next(t for i, t in licenses.KNOWN if i == "ISC")
    bsd = texts["BSD-2-Clause"]
    rows += [(100, "MIT License\n\nCopyright (c) 2021 Someone\n\n" + mit),
             (101, "ISC License\n\nCopyright (c) 2021 Someone\n\n" + isc),
             (102, bsd.replace("1. ", "* ").replace("2. ", "* ")),
             (103, "BSD 3-Clause License\n\nCopyright (c) 2021, Someone\nAll rights reserved.\n\n"
              + next(t for i, t in licenses.KNOWN if i == "BSD-3-Clause" and "copyright holder" in t)),
             (104, "before\n\n" + texts["GPL-2.0"])]
    got = {r.doc_id: r.whole_license for r in licenses.licenses(
        documents(spark, rows), licenses.registry(spark)).collect()}
    assert got == dict(enumerate(names)) | {100: "MIT", 101: "ISC", 102: "BSD-2-Clause",
                                            103: "BSD-3-Clause", 104: None}


def rewrapped(text, width):
    """Each paragraph's words in lines of ``width`` columns; all on one line without a width."""
    if not width:
        return " ".join(text.split())
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False) for p in re.split(licenses.PARAGRAPH, text))


def test_whole_texts_in_any_layout(spark):
    from pathlib import Path
    folder = Path(licenses.__file__).parent / "license_texts"
    texts = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(folder.glob("*.txt"))]
    assert len(texts) == 13
    texts += [(i, t) for i, t in licenses.KNOWN if len(t) > 500 and i in ("MIT", "ISC", "BSD-3-Clause")]
    notices = ["", "Copyright (c) 2021 Someone and others, Inc.\n", "Copyright 2019-2021 A. Writer <a@b.c>\n\n",
               "© 2020 The Holders\n(C) 2021 Other Holder. All rights reserved.\n\n"]
    rows, want = [], {}
    for name, text in texts:
        for width in [0, *range(50, 101, 5)]:
            for notice in notices:
                want[len(rows)] = name
                rows.append((len(rows), notice + rewrapped(text, width)))
    got = {r.doc_id: r.whole_license for r in licenses.licenses(
        documents(spark, rows), licenses.registry(spark)).collect()}
    assert {i: (want[i], got[i]) for i in want if got[i] != want[i]} == {}


def test_body_words_stay_and_notices_go(spark):
    mit, opening = licenses.KNOWN[-1][1], "permission is hereby granted free of charge to"
    forms = [("Copyright notice and this permission is hereby granted free of charge to all", None),
             ("(c) You must retain, in the Source form", "c you must retain in the source form"),
             ("MIT License\nCopyright (c) 2020 X\nPermission is hereby granted, free of charge, to",
              "mit license " + opening),
             ("copyright holders be liable for any claim", None), ("Copyright 2020 Someone", None),
             ("Copyright " + "x " * 101 + opening, None), ("Copyright " + "x " * 100 + opening, opening),
             ("t " * 13 + "copyright 2020 x " + opening, None),
             ("t " * 12 + "copyright 2020 x " + opening, "t " * 12 + opening)]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(forms)], "i int, t string")
    got = {r.i: r.f for r in frame.select("i", licenses.canonical(F.col("t")).alias("f")).collect()}
    for i, (text, form) in enumerate(forms):
        assert got[i] == (form or " ".join(re.sub(r"[\W_]+", " ", text.lower()).split()))
    cut = mit.replace("copyright holders be liable", "be liable").replace("COPYRIGHT HOLDERS BE LIABLE", "BE LIABLE")
    rows = documents(spark, [(1, cut), (2, mit + "\nCopyright 2020 Someone")])
    assert all(r.whole_license is None for r in licenses.licenses(rows, licenses.registry(spark)).collect())


def test_license_statement_on_notices(spark, tmp_path):
    from pathlib import Path
    folder = Path(licenses.__file__).parent / "license_texts"
    gpl, mit = (folder / "GPL-2.0.txt").read_text(), licenses.KNOWN[-1][1]
    opening = "permission is hereby granted free of charge to"
    texts = ["Copyright 2020 A\n" + rewrapped(gpl, 66), "MIT License\n\n© 2020 B " + rewrapped(mit, 0), rewrapped(mit, 40),
             "Copyright 2020 " + "x " * 99 + mit, "Copyright 2020 " + "x " * 100 + mit, "copyright law " + mit,
             "(c) 1999 C\nReleased under the MIT licence.", "prose\nCopyright 2020 D. Licensed under CC BY 4.0.\n\nend",
             "copyright", "c 2020", "copyright c 2020 copyright notice " + opening, None, ""]
    frame = documents(spark, list(enumerate(texts)))
    common.pick(frame, "doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id, text FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = licenses.licenses(frame, licenses.registry(spark))
    assert difference(got, con, queries.OP8) is None
    assert {r.doc_id for r in got.collect() if r.whole_license} == {0, 1, 2, 3, 6}


def test_license_units_are_cut_as_if_each_stood_alone(spark):
    texts = ["a licence licence, b\n(c) 2020 someone\nc\n \t\r\nCopyright x\n\nd\n\n\ne whilst",
             "\x01one\x01\n\x01\ntwo\n\nthree\r\n\r\nfour", "\n\n(C) y\nonly line\n",
             "non-infringement\nnoninfringement\n\nNonInfringement whilst whilst whilst"]
    units = [(n, u) for n, t in enumerate(texts)
             for u in {t, *re.split(licenses.PARAGRAPH, t), *t.split("\n")}]
    forms = (spark.createDataFrame(units, "n int, unit string")
             .select("n", licenses.canonical(F.col("unit")).alias("form")).where("form <> ''").collect())
    known = spark.createDataFrame([(f"L{i}", f) for i, f in enumerate({r.form for r in forms})],
                                  "license_id string, form string")
    known = known.select("license_id", F.sha2("form", 256).alias("digest"))
    got = licenses.licenses(documents(spark, list(enumerate(texts))), known).collect()
    assert {r.doc_id: r.n_units for r in got} == {
        n: len({r.form for r in forms if r.n == n}) for n in range(len(texts))}
    assert "a license license b" in {r.form for r in forms}


# --- decontamination ----------------------------------------------------------------------

def test_decontamination_in_one_and_many_passes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = sorted(map(tuple, decontaminate.hit_table(docs, bench).collect()))
    many = sorted(map(tuple, decontaminate.hit_table(docs, bench, pass_words=300).collect()))
    assert one == many and any(r[-1] for r in one) and not all(r[-1] for r in one)
    kept = decontaminate.clean_documents(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in one if not r[-1]]


def test_decontamination_cases(spark):
    rng = random.Random(6)
    item = prose(rng, 14)
    w = item.split()
    bench = spark.createDataFrame(
        [(1, item, "a"), (10, "short item here", "b"), (2, None, "c"), (3, "", "d"), (None, "clean words", "e"),
         (1, item, "f"), (4, "--- !", "g")], "item_id bigint, text string, Item_id string")
    rows = [(1, f"x {item.upper()} y"), (2, " ".join(w[:9]) + " x " + " ".join(w[9:])),
            (3, " ".join(w[2:12]) + " short, item\there"), (4, "clean words"), *[
                (i and i + 100, t) for i, t in odd_rows()]]
    got = {r.doc_id: r for r in decontaminate.hit_table(documents(spark, rows), bench).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items) == (16, 14, 1)
    assert (got[2].n_hit, got[2].n_items, got[2].contaminated) == (0, 0, False)
    assert (got[3].n_hit, got[3].n_items) == (13, 2)
    assert got[3].items_sha256 == hashlib.sha256(b"1,10").hexdigest()
    assert got[2].items_sha256 == hashlib.sha256(b"").hexdigest() and not got[4].contaminated
    near = {r.doc_id: r.spans for r in decontaminate.matches(documents(spark, rows), bench, slop=2).collect()}
    assert near[2] == [[0, 15]]
    assert sorted(r[0] for r in decontaminate.clean_documents(documents(spark, rows), bench).collect()
                  if r[0] is not None) == [2, 4, 101, 102, 103, 104, 104, 105, 106, 107]
    assert decontaminate.hit_table(documents(spark, []), bench).count() == 0
    assert decontaminate.hit_table(documents(spark, rows), bench.where("false")).where("contaminated").count() == 0


# --- sharding -----------------------------------------------------------------------------

def test_sharding(spark, sf_dir, corpus):
    rows = queries.op10_sharding(spark, sf_dir).collect()
    texts = {i: (t or "").encode() for i, t in corpus}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]))
               for r in rows)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r.grown_shard in (r.shard, 40) for r in rows)
    shrunk = documents(spark, corpus[::3]).repartition(3)
    again = {r.doc_id: r.shard for r in sharding.shard_table(shrunk, 40).collect()}
    assert all(again[r.doc_id] == r.shard for r in rows if r.doc_id in again)


def test_sharding_weights_and_odd_rows(spark):
    ids = spark.range(20_000)
    counts = {r.s: r["count"] for r in ids.groupBy(
        sharding.shard_of(ids.id, {0: 1.0, 1: 2.0, 2: 0.0, 5: 1.0}).alias("s")).count().collect()}
    assert set(counts) == {0, 1, 5} and abs(counts[1] / 20_000 - 0.5) < 0.02
    got = sharding.shard_table(documents(spark, odd_rows()), 2).collect()
    assert len(got) == len(odd_rows()) and {r.size for r in got if r.doc_id in (1, 2)} == {16}
    hot = sharding.shard_table(documents(spark, [(1, "x")] * 50).repartition(7), 4).collect()
    assert sorted(r.slot for r in hot) == list(range(50)) and len({r.shard for r in hot}) == 1
    assert sharding.shard_table(documents(spark, []), 40).count() == 0
    assert sharding.sharded(documents(spark, odd_rows()), 40).columns.count("shard") == 1


# --- pipeline and helpers -----------------------------------------------------------------

def plain_quality(spark, docs, labels):
    """Weights, knots and values of the quality model by dense linear algebra."""
    text = {}
    for r in docs.select("doc_id", "text").collect():
        text.setdefault(r.doc_id, []).append((r.text or "").encode())
    y = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None:
            y.setdefault(r.doc_id, []).append(r.quality)
    known = sorted(set(text) & set(y))
    place = {r.doc_id: r.p for r in spark.createDataFrame([(i,) for i in known], "doc_id bigint").select(
        "doc_id", F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)).alias("p")).collect()}
    rows = [(quality.statistics(t), np.mean(y[i]), place[i] == 0) for i in known for t in text[i]]
    x, y, out = (np.array(v) for v in zip(*rows))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale <= 1e-9] = 1
    z = quality.fourier(x, mean, scale)
    fit = z[~out]
    penalty = np.full(fit.shape[1], quality.RIDGE * len(fit))
    penalty[-1] = 1e-9
    weights = np.linalg.lstsq(np.concatenate([fit, np.diag(np.sqrt(penalty))]),
                              np.concatenate([y[~out], np.zeros(len(penalty))]), rcond=None)[0]
    raw = z[out] @ weights
    at = np.floor(np.clip(raw, 0, 1) * quality.BINS)
    bins = np.unique(at)
    knots, values = quality.isotonic((bins + 0.5) / (quality.BINS + 1), np.array(
        [y[out][at == b].sum() for b in bins]), np.array([(at == b).sum() for b in bins], float))
    return quality.Model(mean, scale, weights, knots, values)


def plain_accepted(spark, docs, labels, rows):
    model = quality.fit(quality.measured(docs), quality.quality_labels(labels))
    scores = model.scores(np.array([quality.statistics((r[1] or "").encode()) for r in rows]))
    return [r for r, score in zip(rows, scores) if score >= 0.7]


def test_quality_fit_agrees_with_dense_algebra(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.fit(quality.measured(docs), quality.quality_labels(labels))
    want = plain_quality(spark, docs, labels)
    assert np.allclose(got.mean, want.mean) and np.allclose(got.scale, want.scale)
    assert np.allclose(got.weights, want.weights, rtol=1e-5, atol=1e-7)
    assert np.allclose(got.knots, want.knots) and np.allclose(got.values, want.values)


def plain_stage(name, rows, sf_dir, spark):
    """Rows that a stage must return, from rows (doc_id, text, source); None where the stage's
    model decides."""
    if name == "near_dedup":
        fps = {r: plain_fingerprint(r[1]) for r in rows}
        order = sorted(fps, key=lambda r: (r[0] is None, r[0] or 0))
        root = plain_components(range(len(order)), [
            (i, j) for j, b in enumerate(order) for i, a in enumerate(order[:j])
            if bin(fps[a] ^ fps[b]).count("1") <= 3])
        return [order[i] for i in sorted(set(root.values()))]
    if name == "decontamination":
        bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
        word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        low = lambda t: word.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        windows = set()
        for _, text in bench:
            w = low(text)
            windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
        sizes = {len(w) for w in windows}
        return [r for r in rows if not any(tuple(w[i:i + n]) in windows for w in [low(r[1])]
                                           for n in sizes for i in range(len(w) - n + 1))]
    return None


def held_to_targets(before, after):
    """The mix of rows (doc_id, text, source): every row whole, at most twice, and the words of
    each source within a text of its target."""
    size = lambda r: len(SPACE.findall(r[1] or ""))
    copies = Counter(after)
    assert set(copies) <= set(before) and all(n <= 2 * before.count(r) for r, n in copies.items() if size(r))
    assert all(r in copies for r in before if not size(r))
    sources = sorted({r[2] for r in before}, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    own = {s: sum(size(r) for r in before if r[2] == s) for s in sources}
    targets, budget, open_ = {}, 1.5 * sum(own.values()), set(sources)
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * own[s] <= level * weight[s]}
        targets |= {s: 2 * own[s] if full else level * weight[s] for s in full or open_}
        budget -= sum(2 * own[s] for s in full)
        open_ = open_ - full if full else set()
    for s in sources:
        took = sum(size(r) for r in after if r[2] == s)
        assert abs(took - targets[s]) <= max(size(r) for r in before if r[2] == s) + 1


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    rows_of = lambda d: [(r.doc_id, r.text, r.source) for r in d.collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns
        before, after = rows_of(docs), rows_of(out)
        if name == "quality":
            assert sorted(after) == sorted(plain_accepted(spark, docs, labels, before))
            assert len(after) < len(before)
        elif name == "mixing":
            held_to_targets(before, after)
        else:
            assert sorted(after) == sorted(plain_stage(name, before, sf_dir, spark))
            assert len(after) < len(before)
        docs = out
    final = corpus_pipeline.run(spark, sf_dir)
    assert final.columns == [*docs.columns, "shard"]
    assert sorted((r.doc_id, r.text) for r in final.collect()) == sorted(
        (r.doc_id, r.text) for r in docs.collect())


def test_pipeline_stages_take_odd_rows(spark, sf_dir):
    import corpus_pipeline
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        assert stage(spark, documents(spark, []), sf_dir).count() == 0
    rows = odd_rows()
    run = lambda name, data=rows: stages[name](spark, documents(spark, data), sf_dir)
    got = lambda df: sorted(((r[0], r[1]) for r in df.collect()), key=str)
    ordered = lambda data: sorted(data, key=str)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert got(run("quality")) == ordered(plain_accepted(spark, documents(spark, rows), labels, rows))
    # Null, empty and blank texts are one group, the repeated line another.
    assert got(run("near_dedup")) == ordered([(1, None), rows[3], rows[8], rows[9]])
    assert got(run("decontamination")) == ordered(rows)
    mixed = got(run("mixing"))
    assert set(mixed) == set(rows) and {(1, None), (2, ""), (3, " \t\n"), (None, None)} <= set(mixed)
    placed = run("sharding")
    assert placed.columns[-1] == "shard" and got(placed) == ordered(rows)


def test_mix_of_rows_without_id_meets_the_target(spark):
    rng = random.Random(31)
    rows = [(None, prose(rng, rng.randrange(5, 40))) for _ in range(200)] + [
        (i, prose(rng, rng.randrange(5, 40))) for i in range(200)]
    sources = {i: "s2" for i in range(200)}
    data = [(i, t, sources.get(i, "s1")) for i, t in rows]
    out = mixing.mixed(documents(spark, rows, sources), [3, 1, 2], 1.5, 2, 42).collect()
    held_to_targets(data, [(r[0], r[1], r[3]) for r in out])
