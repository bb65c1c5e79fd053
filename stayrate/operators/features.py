"""Engineered features, model column selection, one-hot encoding and splitting."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate import schemas
from stayrate.functions import rules
from stayrate.operators import ranks

ENGINEERED = ["CLV", "Tickets_per_Tenure_Year", "Complaint_Satisfaction_Gap",
              "Contract_Ending_Soon", "Price_Pressure", "Revenue_Weighted_Downtime",
              "Company_Size_Rank", "Services_per_Size_Tier"]


def lifetime_value() -> Column:
    """Contract value times tenure plus a satisfaction-dependent horizon, per tenure year."""
    years = F.col("Years_With_Provider")
    horizon = rules.clip(F.col("Customer_Satisfaction_Score") / 2, 0.5, 5.0)
    return F.col("Annual_Contract_Value").cast("double") * (years + horizon) / (years + 1)


def lifetime_value_cents() -> Column:
    """The same to the cent, in DECIMAL on the contract's digits so that rounding is exact."""
    years = F.col("Years_With_Provider").cast("decimal(5,1)")
    half = F.col("Customer_Satisfaction_Score").cast("decimal(4,1)") * F.lit("0.5").cast("decimal(2,1)")
    horizon = F.when(half.isNotNull(), F.greatest(
        F.lit("0.5").cast("decimal(6,2)"), F.least(F.lit("5").cast("decimal(6,2)"), half)))
    value = F.col("Annual_Contract_Value").cast("decimal(14,2)") * (years + horizon) / (years + 1)
    return F.round(value, 2).cast("double")


def engineer(df: DataFrame) -> DataFrame:
    c = F.col
    df = df.withColumns({
        "CLV": lifetime_value(),
        "Tickets_per_Tenure_Year": c("Number_of_Service_Tickets") / (c("Years_With_Provider") + 0.1),
        "Complaint_Satisfaction_Gap":
            c("Number_of_Complaints") * (10 - c("Customer_Satisfaction_Score")),
        "Contract_Ending_Soon":
            F.when(c("Contract_Remaining_Months") <= 3, 1).otherwise(0),
        "Price_Pressure": F.when(c("Competitor_Considered") == 1,
                                 -c("Competitor_Price_Difference")).otherwise(0.0),
        "Revenue_Weighted_Downtime":
            (c("Downtime_Hours").cast("decimal(8,1)") * c("Annual_Contract_Value").cast("decimal(14,2)")
             / 1_000_000).cast("double"),
        "Company_Size_Rank": rules.size_rank(c("Company_Size")),
    })
    return df.withColumn("Services_per_Size_Tier",
                         c("Number_of_Services") / (c("Company_Size_Rank") + 1))


def model_columns(df: DataFrame) -> DataFrame:
    """Engineered frame without identifiers, outcome leakage, collinear halves and target."""
    return engineer(df).drop(*schemas.MODEL_DROPS, schemas.TARGET)


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric model inputs, in column order."""
    kept = model_columns(df)
    return [f.name for f in kept.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in schemas.CATEGORICALS]


def fit_categories(df: DataFrame, columns: list[str] = schemas.CATEGORICALS) -> dict[str, list[str]]:
    """Sorted distinct non-null values per column, read in one pass.

    Each value becomes a model column, so these lists are as long as a model of the columns
    is wide; that is all the driver holds.
    """
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v"))
                               for c in columns]))
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in df.select(pairs).filter(F.col("v").isNotNull()).distinct().collect():
        found[row["c"]].append(row["v"])
    return {c: sorted(values) for c, values in found.items()}


def category_indexes(categories: dict[str, list[str]]) -> list[StringIndexerModel]:
    """A fitted index of the known values of each column that has any. All other values share
    one further index, the last."""
    return [StringIndexerModel.from_labels(values, inputCol=c, outputCol=f"_index_{c}", handleInvalid="keep")
            for c, values in categories.items() if values]


def one_hot_vectors(df: DataFrame, indexes: list[StringIndexerModel]) -> tuple[DataFrame, list[str]]:
    """``df`` with one sparse 0/1 vector per indexed column, an entry for each known value in
    order, and the vectors' names. Unseen and null values give all zeros."""
    if not indexes:
        return df, []
    for index in indexes:
        df = index.transform(df)
    inputs = [index.getOutputCol() for index in indexes]
    flags = [f"_flags_{index.getInputCol()}" for index in indexes]
    # The index of unknown values, being the last, has no entry.
    encoder = OneHotEncoder(inputCols=inputs, outputCols=flags, dropLast=True).fit(df)
    return encoder.transform(df).drop(*inputs), flags


def one_hot(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """Replace each column by one 0/1 column per known category.

    Unseen and null values give all zeros. For more categories than a table has columns,
    see ``one_hot_vectors``.
    """
    encoded = [F.when(F.col(c) == v, 1.0).otherwise(0.0).alias(f"{c}_{v}")
               for c, values in categories.items() for v in values]
    return df.select("*", *encoded).drop(*categories)


def encoded_names(categories: dict[str, list[str]]) -> list[str]:
    return [f"{c}_{v}" for c, values in categories.items() for v in values]


# Multiplicative hash on a prime modulus: well-spread, and the same in any SQL engine.
HASH_MODULUS = 2147483647
HASH_MULTIPLIER = 1327217885


def spread(df: DataFrame, key: str, seed: int) -> Column:
    """A pseudo-random position of ``key`` in [0, HASH_MODULUS).

    The seed shifts the positions before they are raised to the fifth power, a permutation
    of the residues of this modulus, so that each seed orders the keys anew.
    """
    integral = isinstance(df.schema[key].dataType, T.IntegralType)
    number = F.col(key).cast("bigint") if integral else F.xxhash64(F.col(key))
    folded = F.pmod(number, F.lit(HASH_MODULUS))
    shifted = (folded * HASH_MULTIPLIER + F.lit(seed * 1_000_003)) % HASH_MODULUS
    square = shifted * shifted % HASH_MODULUS
    return (square * square % HASH_MODULUS) * shifted % HASH_MODULUS


def stratified_split(df: DataFrame, label: str = schemas.TARGET, key: str = "Customer_ID",
                     share: float = 0.2, seed: int = 42, alias: str = "Is_Test") -> DataFrame:
    """Mark ``share`` of each label's rows, exactly up to hash ties.

    The cut is a hash threshold per label, found on the running counts of the hash
    values; no label's rows are gathered anywhere.
    """
    hashed = df.withColumn("_h", spread(df, key, seed))
    wanted = F.floor(F.col("total_n") * share + 0.5)
    edges = [ranks.even_edges(df, 0, HASH_MODULUS)]
    cuts = (ranks.running_counts(hashed, ["_h"], by=(label,), edges=edges)
            .groupBy(label).agg(F.max(F.when(F.col("before_n") < wanted, F.col("value"))).alias("cut"))
            .collect())
    marked = F.lit(False)
    for row in cuts:
        if row["cut"] is not None:
            marked = F.when(F.col(label) == row[label], F.col("_h") <= int(row["cut"])).otherwise(marked)
    return hashed.withColumn(alias, marked).drop("_h")
