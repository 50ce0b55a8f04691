"""Customer tables derived from the supplied star schema.

The supplied tables hold no subscription customers, so every customer, order or
event row is mapped to one record with the declared columns. Nothing is filtered
or sampled: work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.functions.numbers import money_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(c: Column, choices: list[tuple[str, str]], last: str) -> Column:
    """The first value whose bound is above ``c``."""
    chain = None
    for bound, value in choices:
        chain = F.when(c < bound, value) if chain is None else chain.when(c < bound, value)
    return chain.otherwise(last)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 21 raw columns for every row of ``customer``."""
    k = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias(fv.ID),
        ((k * 7) % 73).alias("tenure"),
        (F.lit(1825) + (k * 37) % 10150).alias("cents"),
        F.when(k % 3 == 0, "Fiber optic").when(k % 3 == 1, "DSL").otherwise("No").alias("InternetService"),
        F.when(k % 11 < 6, "Month-to-month").when(k % 11 < 8, "One year").otherwise("Two year").alias("Contract"),
        F.md5(F.concat(F.lit("addon:"), k.cast("string"))).alias("h"),
        F.substring(F.md5(F.concat(F.lit("churn:"), k.cast("string"))), 1, 4).alias("u"),
    )

    def mark(position: int) -> Column:
        return F.substring("h", position, 1)

    def add_on(position: int) -> Column:
        return F.when(F.col("InternetService") == "No", "No internet service").otherwise(
            _pick(mark(position), [("8", "No")], "Yes")
        )

    due = F.col("tenure") * F.col("cents")
    total = F.concat(F.expr("tenure * cents div 100").cast("string"), F.lit("."), F.lpad((due % 100).cast("string"), 2, "0"))
    monthly = F.col("Contract") == "Month-to-month"
    values = {
        "gender": _pick(mark(4), [("8", "Female")], "Male"),
        "SeniorCitizen": F.when(mark(5) < "3", 1).otherwise(0).cast("long"),
        "Partner": _pick(mark(6), [("8", "Yes")], "No"),
        "Dependents": _pick(mark(7), [("5", "Yes")], "No"),
        "PhoneService": _pick(mark(8), [("e", "Yes")], "No"),
        "MultipleLines": F.when(mark(8) >= "e", "No phone service").otherwise(_pick(mark(9), [("7", "Yes")], "No")),
        "OnlineSecurity": add_on(2),
        "OnlineBackup": add_on(3),
        "DeviceProtection": add_on(10),
        "TechSupport": add_on(1),
        "StreamingTV": add_on(11),
        "StreamingMovies": add_on(12),
        "PaperlessBilling": _pick(mark(13), [("9", "Yes")], "No"),
        "PaymentMethod": _pick(
            mark(14),
            [("4", "Electronic check"), ("8", "Mailed check"), ("c", "Bank transfer (automatic)")],
            "Credit card (automatic)",
        ),
        "MonthlyCharges": F.col("cents").cast("double") / 100,
        "TotalCharges": F.when(F.col("tenure") == 0, " ").otherwise(total),
        "Churn": F.when((monthly & (F.col("u") < "6b85")) | (F.col("u") < "1400"), "Yes").otherwise("No"),
    }
    return base.select(*[values[c].alias(c) if c in values else F.col(c) for c in fv.RAW_COLUMNS])


def finished_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier enrichment results: every document is a note, judged ones have a tag."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    tag = (
        F.when(F.col("toxic") == 1, "Frustrated")
        .when(F.col("quality") == 0, "Dissatisfied")
        .when(F.col("quality") == 1, "Satisfied")
    )
    return documents.join(labels, "doc_id", "left").select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias(fv.ID),
        F.col("text").alias(fv.NOTE),
        tag.alias(fv.TAG),
    )


def _points() -> Column:
    """Risk from a fixed points table, in [0, 1]."""
    points = (
        F.when(F.col("Contract") == "Month-to-month", 45).when(F.col("Contract") == "One year", 20).otherwise(5)
        + F.when(F.col("InternetService") == "Fiber optic", 20).when(F.col("InternetService") == "DSL", 10).otherwise(0)
        + F.when(F.col("tenure") <= 12, 15).otherwise(0)
    )
    return points.cast("double") / 100


def _decided(df: DataFrame) -> DataFrame:
    hit = F.col("probability") >= fv.DECISION_THRESHOLD
    return df.withColumn("prediction", F.when(hit, 1).otherwise(0).cast("long"))


def risk_points(df: DataFrame) -> DataFrame:
    """(id, gender, senior, label, probability, prediction) from the points table."""
    label = F.when(F.col(fv.TARGET) == "Yes", 1).otherwise(0).cast("long").alias("label")
    return _decided(df.select(fv.ID, "gender", "SeniorCitizen", label, _points().alias("probability")))


def rule_runs(enriched: DataFrame) -> DataFrame:
    """(run, id, label, probability, prediction) of three rule-based scorers."""
    label = F.when(F.col(fv.TARGET) == "Yes", 1).otherwise(0).cast("long").alias("label")
    by_note = (F.length(fv.NOTE) % 100).cast("double") / 100
    rows = enriched.select(fv.ID, label, _points().alias("p0"), by_note.alias("p1"))
    scores = (F.col("p0"), F.col("p1"), (F.col("p0") + F.col("p1")) / 2)
    runs = [F.struct(F.lit(run).alias("run"), p.alias("probability")) for run, p in zip(fv.RUN_ORDER, scores)]
    return _decided(rows.select(fv.ID, "label", F.inline(F.array(*runs))))


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer records of doubtful quality, one per event."""
    user, value, kind = F.col("user_id"), F.col("value"), F.col("event_type")
    choice = F.when(user % 4 == 0, "Yes").when(user % 4 == 1, "No").when(user % 4 == 2, "No internet service").otherwise("maybe")
    yes_no = F.when(user % 2 == 0, "Yes").otherwise("No")
    values = {
        fv.ID: F.when(kind != "error", F.concat(F.lit("E"), F.col("event_id").cast("string"))),
        "gender": F.when(kind == "signup", "Female").when(kind == "view", "Male"),
        "SeniorCitizen": user % 3,
        "tenure": F.floor(value) - 5,
        "InternetService": F.when(user % 5 == 0, "DSL")
        .when(user % 5 == 1, "Fiber optic")
        .when(user % 5 == 2, "No")
        .when(user % 5 == 3, "Cable"),
        "Contract": F.when(user % 7 < 3, "Month-to-month").when(user % 7 < 5, "One year").otherwise("Two year"),
        "PaymentMethod": F.lit("Mailed check"),
        "MonthlyCharges": value - 2,
        "TotalCharges": F.when(kind != "click", money_text(value)),
        "Churn": F.when(kind == "purchase", "No").when(kind == "error", "Maybe").otherwise("Yes"),
        **{c: choice for c in fv.INTERNET_ADD_ONS},
    }
    events = table(spark, sf_dir, "events")
    return events.select(*[values.get(c, yes_no).alias(c) for c in fv.RAW_COLUMNS])


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with outcomes and event time, one per event."""
    return scored_from(table(spark, sf_dir, "events"))


def scored_from(events: DataFrame) -> DataFrame:
    probability = F.least(F.col("value") / 200.0, F.lit(1.0))
    return events.select(
        "ts",
        F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0).cast("long").alias("label"),
        F.when(probability >= 0.1, 1).otherwise(0).cast("long").alias("prediction"),
        probability.alias("probability"),
        (F.col("user_id") % 9 != 0).alias("nlp_branch_available"),
    )


def raw_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies as they come: fenced, listed, padded, truncated or mistyped, one per turn."""
    kind = (F.col("conv_id") * 7 + F.col("turn")) % 8
    text = F.col("text")

    def reply(tag: Column) -> Column:
        return F.to_json(F.struct(text.alias(fv.NOTE), tag.alias(fv.TAG)))

    plain = reply(F.lit("Neutral"))
    listed = reply(F.array(F.lit(" Billing Inquiry "), F.lit("Neutral")))
    raw = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(kind == 1, reply(F.lit(" Satisfied ")))
        .when(kind == 2, listed)
        .when(kind == 3, F.concat(plain, F.lit("{")))
        .when(kind == 4, reply(F.lit("Happy")))
        .when(kind == 5, F.concat(F.lit("\n```"), plain, F.lit("```\n")))
        .when(kind == 6, F.to_json(F.struct(F.length(text).alias(fv.NOTE), F.lit("Neutral").alias(fv.TAG))))
        .otherwise(F.to_json(F.struct(text.alias(fv.NOTE), F.array().cast("array<string>").alias(fv.TAG))))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("source_text"), raw.alias("raw"))
