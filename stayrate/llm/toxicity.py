"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols through a lexicon: fixed lists for insult, threat, target, negation
and reported speech, and word stems learned from labelled texts. Three transducers rewrite
the symbols of a clause - one marks what stands in the scope of a negation, one what is
reported speech, one joins insults and threats with a target near them - and are composed
into a single table. The document's score is a logistic weight over its matched clause
patterns; the weights start from the grammar's own and are adjusted to the labels.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import map_arrow, pick, slices, stored, utf8, with_fields

# Labelled texts that a fit reads at most; more are sampled by a hash of their id.
MAX_FIT_ROWS = 200_000
# A learned stem: characters, toxic texts that must hold it, and their least share of the
# texts with it, for stems that alone insult and for mild ones, which clean texts use too.
# A mild stem's share must also be too high for chance, by the log likelihood ratio.
STEM_SIZES, STEM_TEXTS, STRONG_SHARE, MILD_SHARE, MILD_RATIO = (3, 4, 5, 6, 7), 5, 0.85, 0.3, 12.0
MOST_CANDIDATES, MOST_STEMS = 50_000, 4000
# Scope of a negation and reach of a target, in words.
SCOPE, REACH = 3, 6

# The grammar's word lists.
INSULTS = """idiot idiots moron morons clown clowns scum trash worthless pathetic disgusting
stupid loser losers imbecile dumb fool fools filth garbage vermin""".split()
THREATS = """kill hurt destroy crush beat punish shoot stab burn attack smash""".split()
TARGETS = """you your yours yourself he him his she her they them their these those""".split()
NEGATIONS = """not no never nobody hardly isn't aren't wasn't don't won't""".split()
REPORTS = """said says say saying told claims claimed wrote quoted quote called""".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, MILD = range(7)
SYMBOLS = range(7)
# Symbols after rewriting: insult and threat negated or reported.
SPARED_INSULT, SPARED_THREAT = 7, 8
# The last one is how dense mild insults stand: doublings over one in 200 words.
PATTERNS = ("insult", "insult_target", "threat", "threat_target", "spared_insult", "spared_threat",
            "mild", "mild_density")
MOST = (3, 3, 3, 3, 3, 3, 8, 3)
# Weights that the grammar gives a pattern before labels are seen, and the constant.
PRIOR = np.array([2.0, 3.5, 0.3, 3.5, -0.5, -0.5, 0.3, 0.3])
PRIOR_CONSTANT, PRIOR_STRENGTH = -4.0, 0.5

_CLAUSE = regex.compile(r"[.!?;:\n]+")
_WORD = regex.compile(r"[\p{L}\p{M}']+")


@dataclass
class Transducer:
    """A deterministic machine: (state, symbol) -> (state, symbol); absent arcs loop on the
    state ``rest`` gives and copy the symbol."""

    arcs: dict[tuple, tuple]
    start: object = 0
    rest: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (self.rest.get(state, state), symbol))


def compose(first: Transducer, then: Transducer, symbols: range) -> Transducer:
    """The machine that feeds what ``first`` writes to ``then``, over its reachable states."""
    start = (first.start, then.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        a, b = todo.pop()
        for s in symbols:
            a2, mid = first.step(a, s)
            b2, out = then.step(b, mid)
            arcs[(a, b), s] = ((a2, b2), out)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return Transducer(arcs, start)


def negation() -> Transducer:
    """States count the words left in a negation's scope."""
    arcs = {}
    for left in range(SCOPE + 1):
        arcs[left, NEGATION] = (SCOPE, NEGATION)
        if left:
            arcs[left, INSULT] = (left - 1, SPARED_INSULT)
            arcs[left, THREAT] = (left - 1, SPARED_THREAT)
            arcs[left, MILD] = (left - 1, OTHER)
    return Transducer(arcs, 0, {n: max(0, n - 1) for n in range(SCOPE + 1)})


def reported_speech() -> Transducer:
    """After a verb of saying, what follows in the clause is someone else's."""
    return Transducer({(0, REPORT): (1, REPORT), (1, INSULT): (1, SPARED_INSULT),
                       (1, THREAT): (1, SPARED_THREAT), (1, MILD): (1, OTHER)})


def targeting() -> Transducer:
    """Writes pattern numbers + 10: bare, or with a target up to REACH words before or after.

    States: ("none",), ("target", words left), ("open", kind, words left). A target after an
    open insult or threat writes its targeted pattern; the bare one was written before it.
    """
    arcs, rest = {}, {}
    states = [("none",), *[("target", n) for n in range(1, REACH + 1)],
              *[("open", k, n) for k in (INSULT, THREAT) for n in range(1, REACH + 1)]]
    for state in states:
        n = state[-1] if len(state) > 1 else 0
        rest[state] = (*state[:-1], n - 1) if n > 1 else ("none",)
        arcs[state, SPARED_INSULT] = (rest[state], 14)
        arcs[state, SPARED_THREAT] = (rest[state], 15)
        arcs[state, MILD] = (rest[state], 16)
        near = state[0] == "target"
        arcs[state, INSULT] = (state if near else ("open", INSULT, REACH), 11 if near else 10)
        arcs[state, THREAT] = (state if near else ("open", THREAT, REACH), 13 if near else 12)
        met = {INSULT: 11, THREAT: 13}[state[1]] if state[0] == "open" else TARGET
        arcs[state, TARGET] = (("target", REACH), met)
    return Transducer(arcs, ("none",), rest)


def grammar() -> tuple[list[list[int]], list[list[int]]]:
    """The composed machine as two tables [state][symbol]: next state, written symbol."""
    machine = compose(compose(negation(), reported_speech(), SYMBOLS), targeting(), SYMBOLS)
    states = {machine.start: 0}
    for state, _ in machine.arcs:
        states.setdefault(state, len(states))
    go = [[0] * len(SYMBOLS) for _ in states]
    out = [[0] * len(SYMBOLS) for _ in states]
    for (state, symbol), (to, written) in machine.arcs.items():
        go[states[state]][symbol], out[states[state]][symbol] = states[to], written
    return go, out


class Lexicon:
    """Word -> symbol: fixed words first, then the learned stems as prefixes."""

    def __init__(self, stems: dict[str, int]):
        self.fixed = {w: s for s, ws in ((INSULT, INSULTS), (THREAT, THREATS), (TARGET, TARGETS),
                                         (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self.stems = stems
        self.heads = frozenset(s[:min(STEM_SIZES)] for s in stems)
        self.toxic = frozenset(w for w, s in self.fixed.items() if s in (INSULT, THREAT))

    def symbol(self, word: str) -> int:
        found = self.fixed.get(word)
        if found is None:
            found = OTHER
            if word[:min(STEM_SIZES)] in self.heads:
                kinds = {self.stems.get(word[:n], OTHER) for n in STEM_SIZES}
                found = INSULT if INSULT in kinds else MILD if MILD in kinds else OTHER
        return found

    def may_match(self, words: list[str]) -> bool:
        heads, toxic, size = self.heads, self.toxic, min(STEM_SIZES)
        return any(w[:size] in heads or w in toxic for w in words)


def patterns(text: str, lexicon: Lexicon, go, out) -> list[int]:
    """Matched clause patterns of a whole text, each counted up to its MOST."""
    counts = [0] * len(PATTERNS)
    lowered = text.lower()
    words = _WORD.findall(lowered)
    if lexicon.may_match(words):
        for clause in _CLAUSE.split(lowered):
            state = 0
            for word in _WORD.findall(clause):
                symbol = lexicon.symbol(word)
                written = out[state][symbol]
                state = go[state][symbol]
                if written >= 10:
                    counts[written - 10] += 1
                    if written in (11, 13) and symbol == TARGET:
                        counts[written - 11] -= 1  # the bare pattern written before
    counts[-1] = int(math.log2(1 + 200 * counts[6] / max(len(words), 1)))
    return [min(max(c, 0), m) for c, m in zip(counts, MOST)]


def _stems(text: bytes) -> set[str]:
    return {w[:n] for w in _WORD.findall(text.decode("utf-8", "replace").lower())
            for n in STEM_SIZES if len(w) >= n}


def stem_counts(texts: DataFrame, only: frozenset | None = None) -> DataFrame:
    """(stem, n): texts that hold a word with that beginning; added up per slice of texts,
    then before and after the shuffle."""
    def spread(batches):
        for part in slices(batches):
            seen: Counter[str] = Counter()
            for text in utf8(part):
                stems = _stems(text)
                seen.update(stems if only is None else stems & only)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                ["stem", "n"])

    return (texts.select("text").transform(map_arrow, spread, "stem string, n bigint")
            .groupBy("stem").agg(F.sum("n").alias("n")))


def learn_stems(texts: DataFrame, toxic_texts: int, other_texts: int) -> dict[str, int]:
    """Word beginnings that mark toxic texts, as strong (INSULT) or MILD, from ``texts``
    (text, y).

    Of the stems that enough toxic texts hold, at most MOST_CANDIDATES are looked up in the
    other texts, and at most MOST_STEMS are kept, the most frequent first: the size of the
    model is bounded.
    """
    fixed = {w[:n] for w in TARGETS + NEGATIONS + REPORTS for n in STEM_SIZES}
    toxic = {r.stem: r.n for r in stem_counts(texts.where("y = 1")).where(F.col("n") >= STEM_TEXTS)
             .orderBy(F.desc("n"), "stem").limit(MOST_CANDIDATES).collect() if r.stem not in fixed}
    if not toxic:
        return {}
    other = {r.stem: r.n for r in
             stem_counts(texts.where("y = 0"), frozenset(toxic)).collect()}  # MOST_CANDIDATES at most
    kept = {s: INSULT for s, n in toxic.items() if n >= STRONG_SHARE * (n + other.get(s, 0) + 1)}
    # Texts that a longer strong stem explains do not speak for its beginnings.
    explained: dict[str, int] = {}
    for stem in kept:
        for size in STEM_SIZES:
            head = stem[:size]
            explained[head] = max(explained.get(head, 0), toxic[stem])
    for stem, n in toxic.items():
        m, n = other.get(stem, 0), n - explained.get(stem, 0)
        if (stem not in kept and n >= max(STEM_TEXTS, MILD_SHARE * (n + m + 1))
                and surprise(n, toxic_texts, m, other_texts) >= MILD_RATIO):
            kept[stem] = MILD
    return dict(sorted(kept.items(), key=lambda x: -toxic[x[0]])[:MOST_STEMS])


def surprise(n: int, of: int, m: int, rest: int) -> float:
    """Log likelihood ratio of ``n`` in ``of`` texts and ``m`` in the ``rest`` against one
    common rate; zero where the first rate is not the higher one."""
    if n * rest <= m * of:
        return 0.0
    common = (n + m) / (of + rest)
    return sum(k * math.log(k / (t * q)) for k, t, q in (
        (n, of, common), (m, rest, common), (of - n, of, 1 - common), (rest - m, rest, 1 - common))
        if k > 0)


@dataclass
class Model:
    stems: dict[str, int]
    weights: np.ndarray
    constant: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(counts @ self.weights + self.constant)))


def fit_weights(counts: np.ndarray, toxic: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights of the patterns, drawn towards the grammar's own, by Newton steps
    over the distinct pattern counts."""
    x = np.hstack([counts, np.ones((len(counts), 1))])
    prior = np.append(PRIOR, PRIOR_CONSTANT)
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (toxic - total * p) - PRIOR_STRENGTH * (w - prior)
        curve = (x * (total * p * (1 - p))[:, None]).T @ x + PRIOR_STRENGTH * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _counted(rows: DataFrame, stems: dict[str, int]) -> DataFrame:
    """``rows`` (doc_id, text, ...) without the text, with ``counts`` of clause patterns."""
    others = [c for c in rows.columns if c != "text"]
    schema = with_fields(rows.select(*others), "counts array<int>")
    go, out = grammar()

    def count(batches):
        lexicon = Lexicon(stems)
        for part in slices(batches):
            found = [patterns(t.decode("utf-8", "replace"), lexicon, go, out) for t in utf8(part)]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in others], pa.array(found, pa.list_(pa.int32()))],
                schema.names)

    return rows.transform(map_arrow, count, schema)


def fit(documents: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> Model:
    """Stems and weights from ``labels`` (doc_id, y). Null labels and ids are left out,
    labels of one id averaged; of texts with the same longest sentence, copies
    and near copies, one counts towards the stems. Without
    labels the grammar's own weights stand."""
    known = (labels.where("doc_id is not null and y is not null").groupBy("doc_id")
             .agg((F.avg("y") >= 0.5).cast("int").alias("y")))
    count = known.count()
    if count > max_fit_rows:
        share = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
        known = known.where(share < max_fit_rows / count)
    # Labels and chosen texts are bounded by max_fit_rows, so broadcasting them is safe and
    # the texts need no shuffle.
    rows = stored(pick(documents, "doc_id", "text").join(F.broadcast(known), "doc_id")
                  .select("doc_id", "text", "y"), "labelled")
    longest = F.array_max(F.transform(F.split("text", r"[.\n]"),
                                      lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
    once = stored(rows.groupBy(F.xxhash64(longest["x"]).alias("h"), "y")
                  .agg(F.min("doc_id").alias("doc_id")).select("doc_id", "y").distinct(), "once")
    sizes = {r.y: r["count"] for r in once.groupBy("y").count().collect()}
    stems = learn_stems(rows.join(F.broadcast(once), ["doc_id", "y"]).select("text", "y"),
                        sizes.get(1, 0), sizes.get(0, 0))
    # The distinct counts that reach the driver are bounded by the product of MOST + 1.
    groups = (_counted(rows, stems).groupBy("counts")
              .agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n")).collect())
    if not groups:
        return Model(stems, PRIOR, PRIOR_CONSTANT)
    weights, constant = fit_weights(np.array([g.counts for g in groups], float),
                                    np.array([g.toxic for g in groups], float),
                                    np.array([g.n for g in groups], float))
    return Model(stems, weights, constant)


def score_table(documents: DataFrame, labels: DataFrame, threshold: float = 0.7,
                max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, patterns) of every row.

    Labels are learned where crc32(doc_id) mod 3 is not 1. A null text scores like an empty
    one; a null doc_id is not held out. Repeated rows score alike; an empty table gives an
    empty result.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    learn = pick(labels, "doc_id", "toxic").withColumnRenamed("toxic", "y").where(~held)
    model = fit(documents, learn, max_fit_rows)
    counted = _counted(pick(documents, "doc_id", "text"), model.stems)
    total = F.lit(model.constant)
    for i, weight in enumerate(model.weights):
        total = total + F.col("counts")[i] * F.lit(float(weight))
    scored = counted.withColumn("score", 1 / (1 + F.exp(-total)))
    named = F.map_from_arrays(F.array(*map(F.lit, PATTERNS)), F.col("counts"))
    return scored.select("doc_id", held.alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"),
                         F.to_json(named).alias("patterns"))
