"""Mixing sources to target weights by capped water-filling and seeded repetition.

A budget of words is shared over the sources by weight. A source whose share exceeds
``max_epochs`` times its size is held there and the excess goes to the others by weight,
until none is above. Every document of a source is then repeated whole ``floor(rate)``
times, and the rest of the target is met by one more repetition of the documents with the
smallest seeded keys; those at the cut are repeated in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.llm.common import numbered, pick, stored

KEY_BITS, DIGIT_BITS = 40, 10
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def order_key(doc_id: Column, seed: int, text: Column | None = None) -> Column:
    """40 bits of the digest of (seed, doc_id) and, where given, of the text; null ids share
    one value."""
    parts = [F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))]
    if text is not None:
        parts += [F.lit(":"), F.md5(F.coalesce(text, F.lit("")))]
    text = F.concat(*parts)
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def water_level(sources: DataFrame, budget: float) -> float:
    """Level L at which the targets min(cap, L * weight) add up to the budget, or, where
    all caps together are below it, a level at which every source stands at its cap.

    ``sources`` holds ``cap`` and ``weight`` > 0. Each round is one aggregation; holding
    more sources only raises the level, so the rounds end after at most one per source.
    """
    level = None
    while True:
        held = F.lit(False) if level is None else F.col("cap") <= F.lit(level) * F.col("weight")
        caps, free, top = sources.agg(
            F.sum(F.when(held, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(held, 0.0).otherwise(F.col("weight"))),
            F.max(F.col("cap") / F.col("weight"))).first()
        if not free:
            return top or 0.0
        risen = max(0.0, (budget - caps) / free)
        if level is not None and risen <= level:
            return level
        level = risen


def plan(sizes: DataFrame, weights: DataFrame, budget_share: float, max_epochs: int) -> DataFrame:
    """(source, source_size, target, base, extra): words per source, whole repetitions of
    every document, and words of one further repetition.

    ``sizes`` holds source and size, ``weights`` source and weight; null is a source of its
    own. A source without a weight gets none of the budget.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"))
    totals = stored(totals.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left")
                    .select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight")),
                    "sources").withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    words = totals.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(totals.where("weight > 0"), words * budget_share)
    target = F.least("cap", F.lit(level) * F.col("weight"))
    base = F.when(F.col("source_size") > 0,
                  F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size")))
                  ).otherwise(0).cast("bigint")
    extra = F.greatest(F.lit(0), F.round("target") - F.col("base") * F.col("source_size"))
    return (totals.withColumn("target", target).withColumn("base", base)
            .withColumn("extra", extra.cast("bigint"))
            .select("source", "source_size", "target", "base", "extra"))


def cuts(sizes: DataFrame, planned: DataFrame) -> DataFrame:
    """``planned`` with the cut of the further repetition: documents with a key below
    ``cut`` are taken whole, those at it share ``rest`` of ``tie_size`` words.

    The cut is found digit by digit from word sums per (source, digit), which combine on
    the map side; a source never has more than 1,024 sums in one place.
    """
    found = planned.withColumn("prefix", F.lit(0).cast("bigint")).withColumn("rest", F.col("extra"))
    up_to = Window.partitionBy("p_source").orderBy("digit")
    for level in range(1, KEY_BITS // DIGIT_BITS + 1):
        shift = KEY_BITS - level * DIGIT_BITS
        prefix = F.shiftright("key", shift + DIGIT_BITS)
        open_ = found.where("extra > 0").select(F.col("source").alias("p_source"), "prefix", "rest")
        sums = (sizes.where("size > 0").withColumn("digit", F.shiftright("key", shift) % (1 << DIGIT_BITS))
                .join(open_, F.col("source").eqNullSafe(F.col("p_source"))
                      & (prefix == F.col("prefix")))
                .groupBy("p_source", "prefix", "rest", "digit").agg(F.sum("size").alias("n")))
        steps = (sums.withColumn("upto", F.sum("n").over(up_to))
                 .where("upto >= rest and upto - n < rest")
                 .select(F.col("p_source").alias("s_source"),
                         (F.col("prefix") * (1 << DIGIT_BITS) + F.col("digit")).alias("next"),
                         (F.col("rest") - F.col("upto") + F.col("n")).alias("left"), "n"))
        keep = [c for c in found.columns if c not in ("prefix", "rest", "tie_size")]
        found = stored(found.join(steps, F.col("source").eqNullSafe(F.col("s_source")), "left")
                       .select(*keep, F.col("next").alias("prefix"), F.col("left").alias("rest"),
                               F.col("n").alias("tie_size")), "cuts")
    return found.withColumnRenamed("prefix", "cut")


def sized(documents: DataFrame, seed: int, by_text: bool = False) -> DataFrame:
    """(doc_id, source, size, key) of every row, written once for the passes that follow."""
    return stored(pick(documents, "doc_id", "text", "source").select(
        "doc_id", "source", words_of(F.col("text")).alias("size"),
        order_key(F.col("doc_id"), seed, F.col("text") if by_text else None).alias("key")), "sizes")


def cycled_weights(sizes: DataFrame, weights: list[int]) -> DataFrame:
    """Weights dealt to the sources in code-point order, null last, from the start again
    when they run out. One row per source passes through one task here, nothing more."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights) + 1
    return sizes.select("source").distinct().withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), place.cast("int")))


def _takes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds source_size, target, ``whole`` repetitions and words of a partial one."""
    f = found.withColumnRenamed("source", "f_source")
    at_cut = F.col("key") == F.col("cut")
    more = (F.col("key") < F.col("cut")) | (at_cut & (F.col("rest") == F.col("tie_size")))
    part = F.when(at_cut & ~more, F.floor(F.col("size") * (F.col("rest") / F.col("tie_size"))))
    return (rows.join(f, F.col("source").eqNullSafe(F.col("f_source")))
            .withColumn("whole", F.col("base") + F.coalesce(more, F.lit(False)).cast("int"))
            .withColumn("part", F.coalesce(part, F.lit(0)).cast("bigint"))
            .drop("f_source", "base", "extra", "cut", "rest", "tie_size"))


def mix(documents: DataFrame, weights: list[int], budget_share: float, max_epochs: int,
        seed: int) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row.

    A null text has no words; a null source is a source of its own and comes last; repeated
    rows share one key and are treated alike. An empty table gives an empty result.
    """
    rows = sized(documents, seed)
    found = cuts(rows, plan(rows, cycled_weights(rows, weights), budget_share, max_epochs))
    return _takes(rows, found).select(
        "doc_id", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("part")).cast("bigint").alias("taken"))


def mixed(documents: DataFrame, weights: list[int], budget_share: float, max_epochs: int,
          seed: int) -> DataFrame:
    """The rows of the mix, with the columns of ``documents``: each row as often as it is
    taken. A partial repetition counts as whole from half of the text on. Texts are never
    cut, so an empty text, which has no words to take, follows its source's whole epochs,
    at least once. Rows are ordered by id and text, so that only rows equal in both are tied:
    a source whose ids are null or repeated meets its target too."""
    rows = sized(documents, seed, by_text=True)
    found = cuts(rows, plan(rows, cycled_weights(rows, weights), budget_share, max_epochs))
    plain, names, at = numbered(documents)
    out = _takes(plain.withColumn("source", F.col(at["source"]))
                 .withColumn("size", words_of(F.col(at["text"])))
                 .withColumn("key", order_key(F.col(at["doc_id"]), seed, F.col(at["text"]))), found)
    times = F.when(F.col("size") == 0, F.greatest(F.lit(1), F.col("whole"))).otherwise(
        F.col("whole") + (F.col("part") * 2 >= F.col("size")).cast("int")).cast("int")
    return (out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), times)))
            .select(*[F.col(f"_{i}") for i in range(len(names))]).toDF(*names))
