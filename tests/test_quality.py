"""Quality checks on defective rows, and CSV scans."""

import gzip

import pytest
from pyspark.sql import functions as F

from stayrate import schemas
from stayrate.operators import features, quality
from stayrate.plans import reports, retention
from stayrate.sources import files
from tests.frames import accounts, column


def test_duplicates(spark):
    df = accounts(spark, [{}, {}, {}]).withColumn("Customer_ID", F.lit(1).cast("bigint"))
    df = df.unionByName(accounts(spark, [{"Customer_ID": 1, "State": "other"}, {"Customer_ID": 9}]))
    got = {r["Scope"]: r["Duplicates"] for r in quality.duplicate_profile(df).collect()}
    assert got == {"key": 3, "row": 2}


def test_keep_first(spark):
    rows = [{"Customer_ID": 1, "State": "late", "o": 2.0}, {"Customer_ID": 1, "State": "first", "o": 1.0},
            {"Customer_ID": 2, "State": None, "o": 5.0}]
    kept = quality.keep_first(accounts(spark, rows), order="o")
    assert column(kept, "State") == ["first", None]
    again = quality.keep_first(accounts(spark, list(reversed(rows))))
    assert again.count() == 2


def test_bounds_are_inclusive(spark):
    df = accounts(spark, [{"Network_Uptime": 90.0}, {"Network_Uptime": 100.0},
                          {"Network_Uptime": 89.9}, {"Network_Uptime": None}])
    assert [tuple(r) for r in quality.range_violations(df).collect()] == [("Network_Uptime", 1)]


def test_nulls(spark):
    df = accounts(spark, [{"State": None}, {}])
    got = {r["Column_Name"]: (r["Null_Count"], r["Null_Pct"], r["Expected"])
           for r in quality.null_profile(df).collect()}
    assert got["State"] == (1, 50.0, False)
    assert got["Churn_Date"] == (2, 100.0, True)
    clean, report = quality.validate(df)
    assert column(clean, "Competitor_Offer") == ["None", "None"]
    assert ("null_unexpected", "State", 1) in [tuple(r) for r in report.collect()]


def test_outlier_fences_are_strict(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 8, 9])],
                               "Customer_ID int, x double")
    lower, upper = quality.iqr_fences(df, "x")
    assert (lower, upper) == (pytest.approx(2.5 - 6.0), pytest.approx(6.5 + 6.0))
    edge = df.unionByName(spark.createDataFrame([], df.schema))
    assert not any(column(quality.iqr_outliers(edge, "x"), "Is_Outlier"))
    assert quality.iqr_fences(df.filter("false"), "x") is None


def _csv_row(**over):
    # The churn fields and the offer stay empty strings or 'None', as the file writes them.
    values = {n.split()[0]: "1" for n in schemas.CUSTOMERS.replace("\n", " ").split(",") if n.split()}
    values.update({"Customer_ID": "A1", "Company_Name": '"Acme, Inc."', "Churn_Date": "",
                   "Churn_Reason": "", "Churn_Category": "", "Competitor_Offer": "None"}, **over)
    values.pop("2)", None)
    return values


def test_csv_scan(spark, tmp_path):
    names = [p.split()[0] for p in schemas.CUSTOMERS.replace("DECIMAL(14,2)", "DECIMAL").split(",")]
    rows = [_csv_row(), _csv_row(Customer_ID="A2", Churn_Date="2025-03-04", Churn_Reason="Other",
                                 Competitor_Offer="Rival")]
    text = "\n".join([",".join(names), *[",".join(r[n] for n in names) for r in rows]]) + "\n"
    plain, zipped = tmp_path / "c.csv", tmp_path / "z.csv.gz"
    plain.write_text(text)
    with gzip.open(zipped, "wt") as f:
        f.write(text)
    for path, parts in ((plain, None), (zipped, 4)):
        df = files.scan_csv(spark, str(path), partitions=parts)
        assert len(df.columns) == 69
        first, second = df.orderBy("Customer_ID").collect()
        assert first["Company_Name"] == "Acme, Inc."
        assert first["Churn_Date"] is None and first["Churn_Reason"] is None
        assert first["Competitor_Offer"] is None and second["Competitor_Offer"] == "Rival"
        assert str(second["Churn_Date"]) == "2025-03-04"
    assert len(files.load_customers(spark, str(plain)).columns) == 49
    assert files.services_bridge(files.scan_csv(spark, str(plain))).count() == 2 * 20


def test_validation_keeps_the_first_row_of_the_file(spark, tmp_path):
    names = [p.split()[0] for p in schemas.CUSTOMERS.replace("DECIMAL(14,2)", "DECIMAL").split(",")]
    rows = [_csv_row(Customer_ID=f"A{i % 400:03d}", State=f"row{i:04d}") for i in range(1200)]
    path = tmp_path / "dup.csv"
    path.write_text("\n".join([",".join(names), *[",".join(r[n] for n in names) for r in rows]]) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(20_000))
    try:
        clean, report = retention.validated_customers(spark, str(path))
        got = {r["Customer_ID"]: r["State"] for r in clean.select("Customer_ID", "State").collect()}
        found = {(r["Check_Name"], r["Item"]): r["Value"] for r in report.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == {f"A{i:03d}": f"row{i:04d}" for i in range(400)}
    assert found["duplicate", "key"] == 800 and found["duplicate", "row"] == 0
    assert found["null_expected", "Churn_Date"] == 1200
    assert len(clean.columns) == 69


def test_contract_gives_the_documented_model_inputs(spark):
    empty = spark.createDataFrame([], schemas.CUSTOMERS)
    assert len(features.numeric_columns(empty)) == 56
    assert features.model_columns(empty).columns[-1] == "Services_per_Size_Tier"


def test_optional_table(spark, tmp_path):
    assert files.optional_table(spark, str(tmp_path / "nothing")) is None
    spark.range(3).write.parquet(str(tmp_path / "some"))
    assert files.optional_table(spark, str(tmp_path / "some")).count() == 3


def test_split_is_exact_and_stable(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("Customer_ID"),
                                     (F.col("id") % 7 == 0).cast("int").alias("Churn"))
    once = features.stratified_split(df)
    counts = {(r["Churn"], r["Is_Test"]): r["count"] for r in once.groupBy("Churn", "Is_Test").count().collect()}
    assert counts == {(0, True): 172, (0, False): 686, (1, True): 28, (1, False): 114}
    again = features.stratified_split(df.repartition(5))
    assert once.exceptAll(again).count() == 0


def test_null_keys_are_one_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (5, 3), (5, 4), (6, 5)], "Customer_ID int, x int")
    got = {(r["Customer_ID"], r["x"]) for r in quality.keep_first(df, order="x").collect()}
    assert got == {(None, 1), (5, 3), (6, 5)}


def test_unique_rows_are_not_shuffled_for_deduplication(spark):
    unique = spark.range(500).select(F.col("id").alias("Customer_ID"), F.lit("v").alias("x"))
    assert quality.keep_first(unique, order="x") is unique  # none repeats: nothing to do at all
    df = spark.range(501).select((F.col("id") % 500).alias("Customer_ID"), F.lit("v").alias("x"))
    plan = quality.keep_first(df, order="x")._jdf.queryExecution().executedPlan().toString()
    unique_part = plan.split("SortAggregate")[0]
    assert "LeftAnti" in unique_part and "Exchange hashpartitioning" not in unique_part


def test_validate_keeps_the_first_row_without_an_order(spark):
    rows = accounts(spark, [{"Company_Name": "Zeta"}, {"Company_Name": "Alpha"}, {}]).coalesce(1)
    same = rows.withColumn("Customer_ID", F.when(F.col("Customer_ID") < 3, 1).otherwise(3))
    clean, _ = quality.validate(same.sortWithinPartitions(F.desc("Company_Name")))
    assert column(clean.where("Customer_ID = 1"), "Company_Name") == ["Zeta"]


CATALOG = "Service_Name,Service_Category\n"


def test_header_must_match(spark, tmp_path):
    swapped = tmp_path / "swapped.csv"
    swapped.write_text("Service_Category,Service_Name\nCloud,Backup\n")
    with pytest.raises(Exception, match="header|Header|CSV"):
        files.load_catalog(spark, str(swapped)).collect()
    own = tmp_path / "own.csv"
    own.write_text("Product,Service_Category\nBackup,Cloud\n")
    found = files.load_catalog(spark, str(own), rename={"Product": "Service_Name"})
    assert [tuple(r) for r in found.collect()] == [("Backup", "Cloud")]


def test_malformed_rows_are_counted_or_refused(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("Customer_ID,Service_Name\n1,Backup\nx,Backup,more\n3,Backup\n")
    kept = files.load_bridge(spark, str(path), "BIGINT", corrupt="_corrupt")
    assert files.corrupt_rows(kept, "_corrupt").first()["Value"] == 1
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        files.load_bridge(spark, str(path), "BIGINT").collect()


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text(CATALOG + '"Two\nlines",Cloud\n')
    assert [tuple(r) for r in files.load_catalog(spark, str(path), multiline=True).collect()] == [
        ("Two\nlines", "Cloud")]


def test_renamed_and_unlisted_services_stay(spark, tmp_path):
    path = tmp_path / "bridge.csv"
    path.write_text("Customer_ID,Service_Name\n1,Own_Cloud\n1,Other\n")
    held = files.load_bridge(spark, str(path), "BIGINT", {"Own_Cloud": "Provider_Cloud"})
    listed = spark.createDataFrame([("Provider_Cloud", "Cloud")], "Service_Name string, Service_Category string")
    rows = reports.churn_by_service(accounts(spark, [{}]), held, listed).collect()
    assert {(r.Service_Name, r.Service_Category) for r in rows} == {("Provider_Cloud", "Cloud"), ("Other", None)}


def test_refresh_reads_changed_files(spark, sf_dir, tmp_path):
    from stayrate.sources import staging
    folder = str(tmp_path / "tables")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part.filter("p_brand < 'Brand#3'").write.parquet(f"{folder}/part.parquet")
    before = staging.catalog(spark, folder).count()
    part.write.mode("overwrite").parquet(f"{folder}/part.parquet")
    assert staging.catalog(spark, folder).count() == before
    staging.refresh(spark, folder)
    after = staging.catalog(spark, folder).count()
    assert after == part.select("p_brand").distinct().count() > before


def test_integrity_of_missing_keys(spark):
    customers = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "Customer_ID bigint")
    catalog = spark.createDataFrame([("a",), ("b",), ("b",)], "Service_Name string")
    bridge = spark.createDataFrame([(1, "a"), (1, "a"), (2, "z"), (9, "b"), (None, "a"), (2, None), (None, None)],
                                   "Customer_ID bigint, Service_Name string")
    predictions = spark.createDataFrame([(2,), (2,), (7,), (None,)], "Customer_ID bigint")
    got = {r[0]: r[1] for r in quality.integrity_report(customers, bridge, catalog, predictions).collect()}
    assert got == {"pk_customers": 2, "pk_service_catalog": 1, "pk_customer_services": 1,
                   "pk_churn_predictions": 1, "fk_services_customer": 3, "fk_services_catalog": 3,
                   "fk_predictions_customer": 2}
