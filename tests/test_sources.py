from __future__ import annotations

import zipfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.operators import gates
from staywise.operators.clean import default_note_column, display_scores, normalise_form
from staywise.plans.quality import gate_table
from staywise.session import new_folder, work_root, written
from staywise.sources import landing, reports, tables
from staywise.streaming import monitors


def test_csv_by_name_with_missing_tokens(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('tenure,customerID,TotalCharges,MonthlyCharges,extra\n1,a, ,2.5,x\nNA,b,null,nan,N/A\n3.0,"c","",1e2,None\n')
    got = tables.read_csv(spark, str(path), fv.RAW_COLUMNS)
    assert dict(got.dtypes) == {"tenure": "bigint", "customerID": "string", "TotalCharges": "string", "MonthlyCharges": "double", "extra": "string"}
    assert [tuple(r) for r in got.collect()] == [(1, "a", " ", 2.5, "x"), (None, "b", None, None, None), (3, "c", None, 100.0, None)]


def test_free_text_survives_csv(spark):
    rows = [("a", 'says "no",\nthen "yes"'), ("b", "line one\nline two\n"), ("c", " padded "), ("d", "back\\slash \\\" mixed")]
    df = spark.createDataFrame(rows, "customerID string, ticket_note string")
    path = new_folder(spark, "csv")
    tables.write_csv(df, path)
    assert sorted(map(tuple, tables.read_csv(spark, path, free_text=True).collect())) == sorted(rows)


def test_unreadable_upload_is_a_message(spark):
    table, message = tables.read_upload(spark, "/tmp/no/such/upload.csv")
    assert table is None and message.startswith("Failed to read CSV")
    assert tables.read_upload(spark, "")[1] == "Please upload a CSV file."


def test_default_note_only_for_an_absent_column(spark, make_customers):
    assert default_note_column(make_customers({})).first()[fv.NOTE] == "No note provided."
    with_null = make_customers({}).withColumn(fv.NOTE, F.lit(None).cast("string"))
    assert default_note_column(with_null).first()[fv.NOTE] is None


def test_landing_is_idempotent(spark, tmp_path):
    source, target = tmp_path / "a.csv", tmp_path / "b.csv"
    source.write_text("x\n1\n")
    assert landing.land_once(spark, str(source), str(target)) is True
    source.write_text("changed")
    assert landing.land_once(spark, str(source), str(target)) is False
    assert target.read_text() == "x\n1\n"
    with pytest.raises(FileNotFoundError):
        landing.land_once(spark, str(tmp_path / "none.csv"), str(tmp_path / "c.csv"))


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("a.csv", "h\n1\n2\n")
        z.writestr("sub/b.csv", "k\né\n")
    lines = landing.zip_lines(spark, str(tmp_path / "d.zip"))
    assert {(r["member"], r["line"]) for r in lines.collect()} == {("a.csv", "h"), ("a.csv", "1"), ("a.csv", "2"), ("sub/b.csv", "k"), ("sub/b.csv", "é")}
    out = str(tmp_path / "out")
    assert landing.extract_zip(spark, str(tmp_path / "d.zip"), out) is True
    assert [r[0] for r in tables.read_csv(spark, f"{out}/archive=d.zip/member=a.csv").collect()] == ["1", "2"]
    assert landing.extract_zip(spark, str(tmp_path / "d.csv"), out) is False
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("a/b", "one\n")
        z.writestr("a_b", "two\n")
    both = str(tmp_path / "both")
    landing.extract_zip(spark, str(tmp_path / "e.zip"), both)
    assert {tuple(r) for r in spark.read.text(both).select("member", "value").collect()} == {("a/b", "one"), ("a_b", "two")}


def test_gate_files(spark, make_customers):
    root, good, bad = (new_folder(spark, n) for n in ("gate", "good", "bad"))
    make_customers({}).write.parquet(good)
    make_customers({"tenure": 500}).write.parquet(bad)
    suite = gates.raw_suite(schema=fv.RAW_COLUMNS)
    assert gate_table(spark, f"{good}-absent", suite, "none", "ingestion", root) is None
    assert not landing.path_exists(spark, root)
    assert gate_table(spark, good, suite, "good", "ingestion", root).count() == 5
    with pytest.raises(gates.GateViolation):
        gate_table(spark, bad, suite, "bad", "ingestion", root)
    status = {r["dataset"]: r["status"] for r in spark.read.json(f"{root}/status").collect()}
    assert status == {"good": "PASS", "bad": "FAIL"}
    assert {r["dataset"] for r in spark.read.json(f"{root}/report").collect()} == {"good"}


def test_splits_are_pruned(spark):
    path = new_folder(spark, "features")
    df = spark.range(30).select(F.col("id"), F.when(F.col("id") < 20, "train").otherwise("test").alias("split"))
    tables.write_feature_table(df, path)
    part = tables.read_split(spark, path, "test")
    assert part.count() == 10
    assert "PartitionFilters: [isnotnull(split" in part._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    df = written(spark.range(10).select("id", (F.col("id") * 2).alias("a"), F.lit("x").alias("b")), "t")
    plan = df.where("a > 4").groupBy("a").count()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(a), GreaterThan(a,4)]" in plan and "ReadSchema: struct<a:bigint>" in plan


def test_work_root_follows_the_session():
    class Conf(dict):
        pass

    def session(master, **conf):
        context = SimpleNamespace(master=master, applicationId="a1", getCheckpointDir=lambda: "set")
        return SimpleNamespace(conf=Conf(conf), sparkContext=context)

    assert work_root(session("yarn", **{"spark.checkpoint.dir": "hdfs:///shared"})) == "hdfs:///shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_root(session("yarn"))
    assert work_root(session("local[2]")) == work_root(session("local[2]"))


def test_vif_file_is_sorted(spark):
    path = new_folder(spark, "vif")
    reports.write_vif(spark.createDataFrame([("a", 1.0), ("b", 9.0), ("c", 4.0)], "Feature string, VIF double"), path)
    assert [r["Feature"] for r in spark.read.option("header", "true").csv(path).collect()] == ["b", "c", "a"]


def test_form_input(spark):
    rows = [("", "1", "5", "", ""), ("x", "maybe", "6", "12.5", "hello")]
    form = spark.createDataFrame(rows, "customerID string, SeniorCitizen string, tenure string, TotalCharges string, ticket_note string")
    got = [tuple(r) for r in normalise_form(form).collect()]
    assert got == [(None, 1, 5, None, "No note provided"), ("x", 0, 6, "12.5", "hello")]


def test_display_table(spark):
    scores = spark.createDataFrame([("a", 0.123456, True, 0.5, 0.00005)], "customerID string, churn_probability double, churn_prediction boolean, p_structured double, p_nlp double")
    row = display_scores(scores).first().asDict()
    assert row == {"Customer ID": "a", "Churn Prediction": "Yes", "Probability": 0.1235, "Structured Branch": 0.5, "NLP Branch": round(0.00005, 4)}


def test_rolling_monitors(spark):
    rows = [(f"2024-01-{d:02d}", 10, 5.0, 2 if d == 3 else 0, 4, 1 if d > 2 else 4) for d in (1, 2, 3, 5)]
    daily = spark.createDataFrame(rows, "day string, scored bigint, score_sum double, fallbacks bigint, positives bigint, hits bigint")
    got = monitors.rolling_monitors(daily.withColumn("day", F.to_date("day")), days=3).orderBy("day").collect()
    assert [r["rolling_recall"] for r in got] == [1.0, 1.0, 9 / 12, 2 / 8]
    assert [r["recall_alarm"] for r in got] == [False, False, False, True]
    assert [r["fallback_alarm"] for r in got] == [False, False, True, False]


def test_upload_with_line_breaks_and_fractions(spark, tmp_path):
    path = tmp_path / "up.csv"
    path.write_text('customerID,tenure,ticket_note\na,3,"says ""no"",\nthen yes"\nb,3.7,plain\nc,4.0,"x\n\ny"\n')
    got, message = tables.read_upload(spark, str(path))
    assert message == "" and [tuple(r) for r in got.collect()] == [("a", 3, 'says "no",\nthen yes'), ("b", None, "plain"), ("c", 4, "x\n\ny")]


def test_late_rows_are_counted(spark):
    source, out, progress = (new_folder(spark, n) for n in ("scores", "tallies", "progress"))
    columns = "ts timestamp, label bigint, prediction bigint, probability double, nlp_branch_available boolean"
    for day in (10, 20, 1):
        row = spark.sql(f"select timestamp'2024-01-{day:02d} 12:00:00' ts, 1L label, 1L prediction, 0.5D probability, true nlp_branch_available")
        row.coalesce(1).write.mode("append").parquet(source)
    scores = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(source)
    monitors.tallies_stream(scores, out, progress).awaitTermination()
    days = {r.day.day: (r.scored, r.late, r.hits) for r in monitors.latest_tallies(spark.read.parquet(out)).collect()}
    assert days == {10: (1, 0, 1), 20: (1, 0, 1), 1: (1, 1, 1)}
    # A second run goes on from the mark of the first, and a late row corrects its day.
    spark.sql("select timestamp'2024-01-10 13:00:00' ts, 0L label, 1L prediction, 0.5D probability, true nlp_branch_available").write.mode("append").parquet(source)
    monitors.tallies_stream(scores, out, progress).awaitTermination()
    days = {r.day.day: (r.scored, r.late) for r in monitors.latest_tallies(spark.read.parquet(out)).collect()}
    assert days == {10: (2, 1), 20: (1, 0), 1: (1, 1)}


@pytest.mark.parametrize("size", ["64", "257", "100000"])
def test_quoted_line_breaks_in_byte_ranges(spark, tmp_path, size):
    """One file in many tasks, equal to the reader that takes a file whole."""
    import random

    rng = random.Random(5)
    cell = lambda: "".join(rng.choice(['a', 'é', ' ', ',', '"', "\n", "\n\n", "x" * 30]) for _ in range(rng.randint(0, 9)))
    rows = [(str(k), cell(), cell()) for k in range(200)] + [("200", "long\n" * 300, "end")]
    whole = lambda v: '"' + v.replace('"', '""') + '"'
    for name, end, own in (("a.csv", "\n", rows[:120]), ("b.csv", "\r\n", rows[120:])):
        body = end.join(["id,note,other", *[",".join([i, whole(n), whole(o)]) for i, n, o in own]])
        (tmp_path / name).write_bytes((body + end * 2).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = tables.read_csv(spark, str(tmp_path), free_text=True)
        found = sorted(map(tuple, got.collect()))
        if size == "64":
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    options = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}
    plain = spark.read.options(**options).csv(str(tmp_path))
    expected = plain.select(*[tables.missing_to_null(F.col(c)).alias(c) for c in plain.columns])
    assert found == sorted(map(tuple, expected.collect())) and len(found) == 201


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"x\ny"\n')
    (tmp_path / "b.csv").write_text("note,id\nz,2\n")
    with pytest.raises(Exception, match="not that of the other files"):
        tables.read_csv(spark, str(tmp_path), free_text=True).collect()
