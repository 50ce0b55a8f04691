"""Sources, projections and data contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.catalog.registry import query
from staywise.catalog.sql_views import (
    CUSTOMERS,
    ENRICHED,
    EVENT_RECORDS,
    FINISHED,
    RANGE_RULES,
    errors_sql,
    in_list,
    one_of_sql,
    text,
)
from staywise.functions.numbers import money_text, round_exact, to_number
from staywise.operators import clean, contracts, gates
from staywise.operators.explore import missing_counts
from staywise.operators.resume import repeated_ids, with_finished
from staywise.plans import stand_in
from staywise.plans.enrichment import enrich
from staywise.plans.quality import gate_table
from staywise.session import new_folder
from staywise.sources import tables
from staywise.sources.landing import land_once, path_exists
from staywise.streaming.monitors import suite_failure_rate


def enriched(spark, sf):
    return enrich(stand_in.customers(spark, sf), stand_in.finished_notes(spark, sf)).drop("source")


@query("customer_view", FINISHED + "SELECT * EXCLUDE (primary_sentiment_tag) FROM j")
def customer_view(spark, sf):
    joined = with_finished(stand_in.customers(spark, sf), stand_in.finished_notes(spark, sf))
    return joined.drop(fv.TAG)


# --- sources and sinks ------------------------------------------------------------

_NOT_MISSING = f"CASE WHEN ticket_note NOT IN {in_list(fv.CSV_MISSING_TOKENS)} THEN md5(ticket_note) END"


@query(
    "csv_round_trip",
    FINISHED
    + f"SELECT customerID, tenure, MonthlyCharges, TotalCharges, {_NOT_MISSING} AS note_digest, primary_sentiment_tag FROM j",
)
def csv_round_trip(spark, sf):
    """Free text with quotes and line breaks written as CSV and read back."""
    path = new_folder(spark, "csv")
    joined = with_finished(stand_in.customers(spark, sf), stand_in.finished_notes(spark, sf))
    tables.write_csv(joined, path)
    back = tables.read_csv(spark, path, fv.ENRICHED_COLUMNS, free_text=True)
    return back.select(
        fv.ID, "tenure", "MonthlyCharges", "TotalCharges", F.md5(fv.NOTE).alias("note_digest"), fv.TAG
    )


@query(
    "upload_default_note",
    CUSTOMERS + "SELECT customerID, 'No note provided.' AS ticket_note FROM v",
)
def upload_default_note(spark, sf):
    path = new_folder(spark, "upload")
    tables.write_csv(stand_in.customers(spark, sf), path)
    table, _ = tables.read_upload(spark, path)
    return table.select(fv.ID, fv.NOTE)


@query("missing_cells", FINISHED + "SELECT 'ticket_note' AS \"column\", count(*) - count(ticket_note) AS missing FROM j "
       "UNION ALL SELECT 'primary_sentiment_tag', count(*) - count(primary_sentiment_tag) FROM j "
       "UNION ALL SELECT 'TotalCharges', count(*) - count(TotalCharges) FROM j")
def missing_cells(spark, sf):
    joined = with_finished(stand_in.customers(spark, sf), stand_in.finished_notes(spark, sf))
    return missing_counts(joined, [fv.NOTE, fv.TAG, "TotalCharges"])


# --- projections --------------------------------------------------------------------

_DIRTY = """
CASE c_custkey % 12
  WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN ' 7 ' WHEN 2 THEN '1e3' WHEN 3 THEN '+3' WHEN 4 THEN '.5'
  WHEN 5 THEN '1,000' WHEN 6 THEN '$5' WHEN 7 THEN '1_000' WHEN 8 THEN 'nan' WHEN 9 THEN ' '
  WHEN 10 THEN c_mktsegment ELSE '-2.50' END"""
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


@query(
    "numeric_coercion",
    f"WITH d AS (SELECT c_custkey, {_DIRTY} AS dirty FROM customer) "
    f"SELECT c_custkey, dirty, CASE WHEN regexp_matches(dirty, '{_NUMBER}') THEN TRY_CAST(trim(dirty) AS DOUBLE) END AS number FROM d",
)
def numeric_coercion(spark, sf):
    dirty = F.expr(_DIRTY.replace("VARCHAR", "STRING"))
    rows = stand_in.table(spark, sf, "customer").select("c_custkey", dirty.alias("dirty"))
    return rows.withColumn("number", to_number(F.col("dirty")))


@query(
    "complete_rows",
    CUSTOMERS + "SELECT count(*) AS all_rows, count(*) FILTER (TRY_CAST(TotalCharges AS DOUBLE) IS NOT NULL) AS complete_rows FROM v",
)
def complete_rows(spark, sf):
    coerced = clean.coerce_numbers(stand_in.customers(spark, sf), ["TotalCharges"])
    return coerced.agg(
        F.count(F.lit(1)).alias("all_rows"),
        F.count_if(F.col("TotalCharges").isNotNull()).alias("complete_rows"),
    )


def collapsed_sql(c: str) -> str:
    if c in fv.INTERNET_ADD_ONS:
        return f"CASE WHEN {c} = 'No internet service' THEN 'No' ELSE {c} END"
    return f"CASE WHEN {c} = 'No phone service' THEN 'No' ELSE {c} END" if c == "MultipleLines" else c


@query(
    "binary_encoding",
    CUSTOMERS
    + "SELECT customerID, CAST(CASE gender WHEN 'Female' THEN 1 WHEN 'Male' THEN 0 END AS BIGINT) AS gender, "
    + ", ".join(
        f"CAST(CASE {collapsed_sql(c)} WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS BIGINT) AS {c}" for c in fv.BINARY_MAP_COLUMNS
    )
    + " FROM v",
)
def binary_encoding(spark, sf):
    mapped = clean.map_binaries(clean.collapse_redundant(stand_in.customers(spark, sf)))
    return mapped.select(fv.ID, "gender", *fv.BINARY_MAP_COLUMNS)


@query(
    "scoring_projection",
    EVENT_RECORDS
    + "SELECT customerID, "
    + ", ".join("coalesce(TotalCharges, '') AS TotalCharges" if c == "TotalCharges" else c for c in fv.SCORING_COLUMNS)
    + " FROM er",
)
def scoring_projection(spark, sf):
    return clean.scoring_projection(stand_in.event_records(spark, sf), [fv.ID])


@query(
    "form_normalisation",
    EVENT_RECORDS
    + """SELECT nullif(coalesce(customerID, ''), '') AS customerID,
                CASE WHEN SeniorCitizen IN (0, 1) THEN SeniorCitizen ELSE 0 END AS SeniorCitizen,
                tenure, nullif(coalesce(TotalCharges, ''), '') AS TotalCharges,
                CASE WHEN gender IS NULL THEN 'No note provided' ELSE 'Caller is ' || gender END AS ticket_note FROM er""",
)
def form_normalisation(spark, sf):
    typed = stand_in.event_records(spark, sf).withColumns(
        {
            fv.ID: F.coalesce(fv.ID, F.lit("")),
            "TotalCharges": F.coalesce("TotalCharges", F.lit("")),
            fv.NOTE: F.coalesce(F.concat(F.lit("Caller is "), "gender"), F.lit("")),
        }
    )
    return clean.normalise_form(typed).select(fv.ID, "SeniorCitizen", "tenure", "TotalCharges", fv.NOTE)


@query(
    "enrichment_defaults",
    "SELECT o_orderkey, 'unknown' AS customerID, CAST(0 AS BIGINT) AS tenure, 'Female' AS gender, "
    "coalesce(o_orderstatus, 'nan') AS Contract, o_totalprice AS MonthlyCharges, 'Mailed check' AS PaymentMethod, "
    "'No' AS InternetService FROM orders",
)
def enrichment_defaults(spark, sf):
    """Absent columns take their defaults, present ones are kept."""
    rows = stand_in.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("Contract"), F.col("o_totalprice").alias("MonthlyCharges")
    )
    return clean.enrichment_inputs(rows).select(
        "o_orderkey", fv.ID, "tenure", "gender", "Contract", "MonthlyCharges", "PaymentMethod", "InternetService"
    )


@query(
    "first_orders",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50",
)
def first_orders(spark, sf):
    """The row limit of an enrichment run."""
    return clean.first_rows(stand_in.table(spark, sf, "orders"), 50, "o_orderkey").select("o_orderkey", "o_totalprice")


_PRODUCT = "l_extendedprice * l_discount * (1 - l_tax)"


@query(
    "money_text",
    f"SELECT l_orderkey, l_linenumber, l_partkey, printf('%.2f', {_PRODUCT}) AS money FROM lineitem",
)
def money(spark, sf):
    product = F.col("l_extendedprice") * F.col("l_discount") * (1 - F.col("l_tax"))
    return stand_in.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", money_text(product).alias("money")
    )


@query(
    "score_rounding",
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(printf('%.6f', l_quantity / l_extendedprice) AS DOUBLE) AS score, "
    "CAST(printf('%.4f', l_quantity / l_extendedprice) AS DOUBLE) AS shown FROM lineitem",
)
def score_rounding(spark, sf):
    share = F.col("l_quantity") / F.col("l_extendedprice")
    return stand_in.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        round_exact(share, fv.SCORE_DIGITS).alias("score"),
        round_exact(share, fv.DISPLAY_DIGITS).alias("shown"),
    )


# --- dataset gates ----------------------------------------------------------------------


def _gate_row(position, suite, kind, column, broken, judged, mostly=1.0, source="v"):
    name = text(column) if column else "CAST(NULL AS VARCHAR)"
    if column is None:
        return (
            f"SELECT CAST({position} AS BIGINT) AS position, {text(suite)} AS suite, {text(kind)} AS expectation, {name} AS \"column\", "
            "true AS success, CAST(NULL AS BIGINT) AS element_count, CAST(NULL AS BIGINT) AS unexpected_count, "
            "CAST(NULL AS DOUBLE) AS unexpected_fraction, CAST(1 AS DOUBLE) AS threshold"
        )
    judged_n, broken_n = f"count(*) FILTER ({judged})", f"count(*) FILTER (({judged}) AND ({broken}))"
    fraction = f"CAST({broken_n} AS DOUBLE) / nullif({judged_n}, 0)"
    kept = f"CAST({judged_n} - {broken_n} AS DOUBLE) / nullif({judged_n}, 0)"
    return (
        f"SELECT CAST({position} AS BIGINT), {text(suite)}, {text(kind)}, {name}, coalesce({kept}, 1) >= {mostly}, count(*), {broken_n}, "
        f"coalesce({fraction}, 0), CAST({mostly} AS DOUBLE) FROM {source}"
    )


def _raw_gate_sql(source):
    between, in_set = "expect_column_values_to_be_between", "expect_column_values_to_be_in_set"
    rows = [
        _gate_row(0, "raw_customer_suite", "expect_table_columns_to_match_set", None, None, None),
        _gate_row(1, "raw_customer_suite", between, "tenure", "tenure < 0 OR tenure > 120", "tenure IS NOT NULL", source=source),
    ]
    for i, (c, values) in enumerate(
        [("InternetService", fv.INTERNET_SERVICES), ("Contract", fv.CONTRACTS), ("Churn", fv.YES_NO)]
    ):
        rows.append(
            _gate_row(2 + i, "raw_customer_suite", in_set, c, f"{c} NOT IN {in_list(values)}", f"{c} IS NOT NULL", source=source)
        )
    return " UNION ALL ".join(rows)


def _enriched_gate_sql(source):
    suite = "enriched_customer_suite"
    return " UNION ALL ".join(
        [
            _gate_row(0, suite, "expect_table_columns_to_match_set", None, None, None),
            _gate_row(1, suite, "expect_column_values_to_not_be_null", "ticket_note", "ticket_note IS NULL", "true", 0.95, source),
            _gate_row(2, suite, "expect_column_value_lengths_to_be_between", "ticket_note", "length(ticket_note) < 10",
                      "ticket_note IS NOT NULL", 0.9, source),
            _gate_row(3, suite, "expect_column_values_to_be_in_set", "primary_sentiment_tag",
                      f"primary_sentiment_tag NOT IN {in_list(fv.SENTIMENT_TAGS)}", "primary_sentiment_tag IS NOT NULL", 0.95, source),
        ]
    )


@query("raw_gate_report", CUSTOMERS + _raw_gate_sql("v"))
def raw_gate_report(spark, sf):
    return gates.gate_report(stand_in.customers(spark, sf), gates.raw_suite(schema=fv.RAW_COLUMNS))


@query("raw_gate_report_dirty", EVENT_RECORDS + _raw_gate_sql("er"))
def raw_gate_report_dirty(spark, sf):
    return gates.gate_report(stand_in.event_records(spark, sf), gates.raw_suite(schema=fv.RAW_COLUMNS))


@query("enriched_gate_report", ENRICHED + _enriched_gate_sql("e"))
def enriched_gate_report(spark, sf):
    return gates.gate_report(enriched(spark, sf), gates.enriched_suite(schema=fv.ENRICHED_COLUMNS))


@query("unfinished_gate_report", FINISHED + _enriched_gate_sql("j"))
def unfinished_gate_report(spark, sf):
    joined = with_finished(stand_in.customers(spark, sf), stand_in.finished_notes(spark, sf))
    return gates.gate_report(joined, gates.enriched_suite(schema=fv.ENRICHED_COLUMNS))


_LABEL = "expectation || ' on ''' || coalesce(\"column\", 'table') || ''''"


@query(
    "gate_failures",
    EVENT_RECORDS + f", g AS ({_raw_gate_sql('er')}) "
    f"SELECT count(*) FILTER (NOT success) AS failed, string_agg({_LABEL}, '; ' ORDER BY position) FILTER (NOT success) AS first_failures FROM g",
)
def gate_failures(spark, sf):
    report = gates.gate_report(stand_in.event_records(spark, sf), gates.raw_suite(schema=fv.RAW_COLUMNS))
    return gates.failure_labels(report).select("failed", F.array_join("first_failures", "; ").alias("first_failures"))


@query(
    "gate_run_files",
    CUSTOMERS + f", g AS ({_raw_gate_sql('v')}) SELECT 'customers' AS dataset, 'PASS' AS status, "
    "count(*) AS checks, count(*) FILTER (success) AS passed FROM g",
)
def gate_run_files(spark, sf):
    """A passing gate leaves its status and report in the working folder."""
    root, path = new_folder(spark, "gate"), new_folder(spark, "raw")
    stand_in.customers(spark, sf).write.parquet(path)
    gate_table(spark, path, gates.raw_suite(schema=fv.RAW_COLUMNS), "customers", "ingestion", root)
    status = spark.read.schema("dataset string, status string").json(f"{root}/status")
    written = spark.read.schema(f"{gates.REPORT_SCHEMA}, dataset string").json(f"{root}/report")
    checks = written.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("success")).alias("passed")
    )
    return status.join(checks, "dataset")


@query(
    "gate_run_failure",
    EVENT_RECORDS + f", g AS ({_raw_gate_sql('er')}) SELECT 'events' AS dataset, 'FAIL' AS status, "
    "'Dataset events failed ' || count(*) FILTER (NOT success) || ' expectations.' AS message, "
    "(SELECT count(*) FROM er) AS row_count_affected, false AS report_written, true AS absent_is_skipped FROM g",
)
def gate_run_failure(spark, sf):
    """A failing gate leaves its status, no report, and says what failed; an absent table is skipped."""
    root, path = new_folder(spark, "gate"), new_folder(spark, "raw")
    suite = gates.raw_suite(schema=fv.RAW_COLUMNS)
    skipped = gate_table(spark, path, suite, "events", "ingestion", root) is None
    stand_in.event_records(spark, sf).write.parquet(path)
    try:
        gate_table(spark, path, suite, "events", "ingestion", root)
        message, affected = "", 0
    except gates.GateViolation as broken:
        message, affected = str(broken), broken.row_count_affected
    status = spark.read.schema("dataset string, status string").json(f"{root}/status")
    return status.withColumns(
        {
            "message": F.lit(message),
            "row_count_affected": F.lit(affected).cast("long"),
            "report_written": F.lit(path_exists(spark, f"{root}/report")),
            "absent_is_skipped": F.lit(skipped),
        }
    )


@query(
    "landing_copy",
    CUSTOMERS + "SELECT customerID, tenure, MonthlyCharges, TotalCharges, true AS copied, false AS copied_again FROM v",
)
def landing_copy(spark, sf):
    """Raw files land once; landing them again leaves the copy as it is."""
    source, target = new_folder(spark, "outside"), new_folder(spark, "landed")
    tables.write_csv(stand_in.customers(spark, sf), source)
    copied, again = land_once(spark, source, target), land_once(spark, source, target)
    landed = tables.read_csv(spark, target, fv.RAW_COLUMNS)
    return landed.select(fv.ID, "tenure", "MonthlyCharges", "TotalCharges", F.lit(copied).alias("copied"), F.lit(again).alias("copied_again"))


@query("repeated_ids", "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def repeated(spark, sf):
    """The ids for which a table of results would be refused."""
    return repeated_ids(stand_in.table(spark, sf, "lineitem"), "l_orderkey")


@query(
    "uploaded_notes",
    "SELECT doc_id AS tenure, md5(replace(text, chr(13), '')) AS note_digest FROM documents",
)
def uploaded_notes(spark, sf):
    """An uploaded CSV whose notes hold quotes and line breaks, record by record."""
    path = new_folder(spark, "upload")
    documents = stand_in.table(spark, sf, "documents").select(F.col("doc_id").alias("tenure"), F.col("text").alias(fv.NOTE))
    tables.write_csv(documents, path)
    uploaded, _ = tables.read_upload(spark, path)
    return uploaded.select("tenure", F.md5(F.replace(fv.NOTE, F.lit("\r"), F.lit(""))).alias("note_digest"))


@query(
    "suite_failure_monitor",
    EVENT_RECORDS + f", g AS ({_raw_gate_sql('er')}) SELECT suite, count(*) AS checks, count(*) FILTER (NOT success) AS failed, "
    "CAST(count(*) FILTER (NOT success) AS DOUBLE) / count(*) AS failure_rate, "
    "CAST(count(*) FILTER (NOT success) AS DOUBLE) / count(*) > 0.02 AS alarm FROM g GROUP BY suite",
)
def suite_failure_monitor(spark, sf):
    report = gates.gate_report(stand_in.event_records(spark, sf), gates.raw_suite(schema=fv.RAW_COLUMNS))
    return suite_failure_rate(report, ["suite"])


# --- row contracts ---------------------------------------------------------------------


def _errors(df, contract, keys):
    checked = contracts.with_errors(df, contract)
    return checked.select(*keys, F.array_join("errors", "; ").alias("errors"))


_RAW_REQUIRED = [c for c in fv.RAW_COLUMNS if c != "TotalCharges"]
_KEYS = ["customerID", "tenure", "MonthlyCharges"]
_KEYS_SQL = ", ".join(_KEYS)


@query("customer_row_errors", EVENT_RECORDS + f"SELECT {_KEYS_SQL}, {errors_sql(_RAW_REQUIRED, RANGE_RULES)} AS errors FROM er")
def customer_row_errors(spark, sf):
    return _errors(stand_in.event_records(spark, sf), contracts.CUSTOMER_ROW, _KEYS)


@query("enriched_row_errors", ENRICHED + f"SELECT {_KEYS_SQL}, {errors_sql(_RAW_REQUIRED, RANGE_RULES)} AS errors FROM e")
def enriched_row_errors(spark, sf):
    return _errors(enriched(spark, sf), contracts.ENRICHED_ROW, _KEYS)


_INPUT_RULES = [
    *RANGE_RULES,
    one_of_sql("InternetService", fv.INTERNET_SERVICES),
    *[one_of_sql(c, fv.ADD_ON_VALUES) for c in fv.INTERNET_ADD_ONS],
    one_of_sql("Contract", fv.CONTRACTS),
]
_AS_INPUT = (
    ", ei AS (SELECT event_id, "
    + ", ".join(f"coalesce({c}, 'nan') AS {c}" if isinstance(d, str) else c for c, d in fv.ENRICHMENT_DEFAULTS.items())
    + " FROM er) "
)


@query(
    "enrichment_input_errors",
    EVENT_RECORDS + _AS_INPUT + f"SELECT {_KEYS_SQL}, {errors_sql(list(fv.ENRICHMENT_DEFAULTS), _INPUT_RULES)} AS errors FROM ei",
)
def enrichment_input_errors(spark, sf):
    return _errors(clean.enrichment_inputs(stand_in.event_records(spark, sf)), contracts.ENRICHMENT_INPUT, _KEYS)


@query(
    "note_output_errors",
    FINISHED
    + "SELECT customerID, "
    + errors_sql(
        ["ticket_note", "primary_sentiment_tag"],
        [("ticket_note: empty", "length(ticket_note) < 1"), one_of_sql("primary_sentiment_tag", fv.SENTIMENT_TAGS)],
    )
    + " AS errors FROM ex",
)
def note_output_errors(spark, sf):
    return _errors(stand_in.finished_notes(spark, sf), contracts.NOTE_OUTPUT, [fv.ID])


_REQUEST_REQUIRED = [c for c in fv.SCORING_COLUMNS if c != "TotalCharges"] + ["ticket_note"]


@query(
    "score_request_split",
    EVENT_RECORDS
    + f", q AS (SELECT {errors_sql(_REQUEST_REQUIRED, RANGE_RULES)} AS errors FROM (SELECT *, TotalCharges AS ticket_note FROM er)) "
    "SELECT count(*) FILTER (errors = '') AS accepted, count(*) FILTER (errors <> '') AS quarantined FROM q",
)
def score_request_split(spark, sf):
    requests = stand_in.event_records(spark, sf).withColumn(fv.NOTE, F.col("TotalCharges"))
    checked = contracts.with_errors(requests, contracts.SCORE_REQUEST)
    return checked.agg(
        F.count_if(F.size("errors") == 0).alias("accepted"), F.count_if(F.size("errors") > 0).alias("quarantined")
    )


@query(
    "vector_table_errors",
    "SELECT vec_id, CASE WHEN len(embedding) <> 60 + label THEN 'embedding: length is not dim' ELSE '' END AS errors FROM embeddings",
)
def vector_table_errors(spark, sf):
    vectors = stand_in.table(spark, sf, "embeddings").withColumn("dim", F.col("label") + 60)
    return _errors(vectors, contracts.vector_contract(), ["vec_id"])


@query(
    "score_response_errors",
    "SELECT event_id, CASE WHEN value / 100 > 1 THEN 'churn_probability: outside 0..1' ELSE '' END AS errors FROM events",
)
def score_response_errors(spark, sf):
    responses = stand_in.table(spark, sf, "events").select(
        "event_id",
        (F.col("value") / 100).alias("churn_probability"),
        (F.col("value") >= 50).alias("churn_prediction"),
        F.least(F.col("value") / 1000, F.lit(1.0)).alias("p_structured"),
        F.least(F.col("value") / 1000, F.lit(1.0)).alias("p_nlp"),
        F.lit(True).alias("nlp_branch_available"),
        F.lit("1").alias("model_version"),
    )
    return _errors(responses, contracts.SCORE_RESPONSE, ["event_id"])


@query(
    "scored_table_check",
    "WITH a AS (SELECT c_custkey AS id, count(*) AS asked FROM customer GROUP BY 1), "
    "s AS (SELECT o_custkey AS id, count(*) AS answered FROM orders GROUP BY 1) "
    "SELECT CAST(coalesce(sum(asked), 0) AS BIGINT) AS requests, CAST(coalesce(sum(answered), 0) AS BIGINT) AS total, "
    "bool_and(asked IS NOT DISTINCT FROM answered) AS consistent FROM a FULL JOIN s ON a.id = s.id",
)
def scored_table_check(spark, sf):
    asked = stand_in.table(spark, sf, "customer").select(F.col("c_custkey").alias(fv.ID))
    answered = stand_in.table(spark, sf, "orders").select(F.col("o_custkey").alias(fv.ID))
    return contracts.scored_table_check(asked, answered)

