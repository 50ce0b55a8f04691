"""Enrichment: rules, reply repair, resume, generation, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.catalog.registry import query
from staywise.catalog.sql_views import (
    CUSTOMERS,
    ENRICHED,
    EVENT_RECORDS,
    FINISHED,
    MONEY,
    RANGE_RULES,
    RULE_NOTE,
    RULE_TAG,
    errors_sql,
    filled,
    in_list,
    one_of_sql,
)
from staywise.catalog.data_checks import enriched
from staywise.functions.text import charges_text, parse_reply, profile_text, rule_note, rule_tag
from staywise.operators import resume, tags
from staywise.plans import stand_in
from staywise.plans.enrichment import enrich, generate_notes
from staywise.session import new_folder
from staywise.streaming.jobs import enrich_stream, open_rows


@query("rule_notes", CUSTOMERS + f"SELECT customerID, {RULE_NOTE} AS ticket_note, {RULE_TAG} AS primary_sentiment_tag FROM v")
def rule_notes(spark, sf):
    priced = stand_in.customers(spark, sf).withColumn("charges", charges_text())
    return priced.select(fv.ID, rule_note(F.col("charges")).alias(fv.NOTE), rule_tag().alias(fv.TAG))


_PROFILE_VALUES = {
    **{c: f"CAST({c} AS VARCHAR)" for c in fv.ENRICHMENT_DEFAULTS},
    "senior": "CASE WHEN SeniorCitizen = 1 THEN 'Yes' ELSE 'No' END",
    "charges": MONEY,
}


@query("profile_text", CUSTOMERS + f"SELECT customerID, {filled(fv.PROFILE_TEMPLATE, _PROFILE_VALUES)} AS profile FROM v")
def profile(spark, sf):
    return stand_in.customers(spark, sf).select(fv.ID, profile_text(charges_text()).alias("profile"))


_REPLY_SQL = f"""
WITH k AS (SELECT conv_id, turn, text, (conv_id * 7 + turn) % 8 AS kind FROM conversations),
p AS (SELECT *, CASE kind WHEN 0 THEN 'Neutral' WHEN 1 THEN 'Satisfied' WHEN 2 THEN 'Billing Inquiry' WHEN 5 THEN 'Neutral' END AS tag
      FROM k)
SELECT conv_id, turn, CASE WHEN tag IN {in_list(fv.SENTIMENT_TAGS)} AND length(text) >= 1 THEN text END AS ticket_note,
       CASE WHEN length(text) >= 1 THEN tag END AS primary_sentiment_tag FROM p"""


@query("heal_replies", _REPLY_SQL)
def heal_replies(spark, sf):
    replies = stand_in.raw_replies(spark, sf).withColumn("reply", parse_reply(F.col("raw")))
    return replies.select("conv_id", "turn", F.col("reply.ticket_note"), F.col("reply.primary_sentiment_tag"))


_USABLE = f"tag IN {in_list(fv.SENTIMENT_TAGS)} AND length(text) >= 1"


@query(
    "tiered_generation",
    CUSTOMERS
    + f""", rk AS (SELECT conv_id, turn, text, (conv_id * 7 + turn) % 8 AS kind FROM conversations),
     rp AS (SELECT *, CASE kind WHEN 0 THEN 'Neutral' WHEN 1 THEN 'Satisfied' WHEN 2 THEN 'Billing Inquiry' WHEN 5 THEN 'Neutral' END AS tag FROM rk),
     ra AS (SELECT conv_id AS a_id, text AS a_text, tag AS a_tag FROM rp WHERE turn = 0 AND {_USABLE}),
     rb AS (SELECT conv_id AS b_id, text AS b_text, tag AS b_tag FROM rp WHERE turn = 1 AND {_USABLE}),
     rj AS (SELECT * FROM v LEFT JOIN ra ON a_id = CAST(substr(customerID, 10) AS BIGINT) LEFT JOIN rb ON b_id = CAST(substr(customerID, 10) AS BIGINT))
     SELECT customerID, CASE WHEN a_id IS NOT NULL THEN 'primary' WHEN b_id IS NOT NULL THEN 'secondary' ELSE 'rules' END AS source,
       coalesce(a_text, b_text, {RULE_NOTE}) AS ticket_note, coalesce(a_tag, b_tag, {RULE_TAG}) AS primary_sentiment_tag FROM rj""",
)
def tiered_generation(spark, sf):
    """Replies of two tiers, some of them unusable or absent; rules cover the rest."""
    replies = stand_in.raw_replies(spark, sf)
    tier = lambda turn, name: replies.where(F.col("turn") == turn).select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("conv_id").cast("string"), 9, "0")).alias(fv.ID), F.col("raw").alias(name)
    )
    asked = stand_in.customers(spark, sf).join(tier(0, "first_reply"), fv.ID, "left").join(tier(1, "second_reply"), fv.ID, "left")
    done = generate_notes(asked, F.lit(True), "first_reply", "second_reply")
    return done.select(fv.ID, "source", F.col("new_note").alias(fv.NOTE), F.col("new_tag").alias(fv.TAG))


@query("resume_merge", FINISHED + "SELECT customerID, md5(ticket_note) AS note_digest, primary_sentiment_tag FROM j")
def resume_merge(spark, sf):
    joined = resume.with_finished(stand_in.customers(spark, sf), stand_in.finished_notes(spark, sf))
    return joined.select(fv.ID, F.md5(fv.NOTE).alias("note_digest"), fv.TAG)


@query(
    "resume_pending",
    FINISHED + "SELECT customerID, tenure FROM j WHERE ticket_note IS NULL OR primary_sentiment_tag IS NULL",
)
def resume_pending(spark, sf):
    return resume.pending_rows(stand_in.customers(spark, sf), stand_in.finished_notes(spark, sf)).select(fv.ID, "tenure")


@query(
    "resume_progress",
    FINISHED + "SELECT count(*) AS total, count(*) FILTER (ticket_note IS NOT NULL AND primary_sentiment_tag IS NOT NULL) AS processed, "
    "count(*) FILTER (ticket_note IS NULL OR primary_sentiment_tag IS NULL) AS pending FROM j",
)
def resume_progress(spark, sf):
    return resume.progress(resume.with_finished(stand_in.customers(spark, sf), stand_in.finished_notes(spark, sf)))


_ENRICHED_OUT = "SELECT customerID, md5(ticket_note) AS note_digest, primary_sentiment_tag FROM e"


@query("write_back", ENRICHED + _ENRICHED_OUT)
def write_back(spark, sf):
    """Results of the pending rows joined back into the table."""
    raw, finished = stand_in.customers(spark, sf), stand_in.finished_notes(spark, sf)
    results = enrich(resume.pending_rows(raw, finished))
    merged = resume.write_back(resume.with_finished(raw, finished), results)
    return merged.select(fv.ID, F.md5(fv.NOTE).alias("note_digest"), fv.TAG)


@query("enrichment_job", ENRICHED + _ENRICHED_OUT)
def enrichment_job(spark, sf):
    return enriched(spark, sf).select(fv.ID, F.md5(fv.NOTE).alias("note_digest"), fv.TAG)


_EVENT_INPUT_RULES = [
    *RANGE_RULES,
    one_of_sql("InternetService", fv.INTERNET_SERVICES),
    *[one_of_sql(c, fv.ADD_ON_VALUES) for c in fv.INTERNET_ADD_ONS],
    one_of_sql("Contract", fv.CONTRACTS),
]


@query(
    "enrichment_of_dirty_rows",
    EVENT_RECORDS
    + ", ei AS (SELECT event_id, customerID AS raw_id, "
    + ", ".join(f"coalesce({c}, 'nan') AS {c}" if isinstance(d, str) else c for c, d in fv.ENRICHMENT_DEFAULTS.items())
    + f" FROM er), ok AS (SELECT *, {errors_sql(list(fv.ENRICHMENT_DEFAULTS), _EVENT_INPUT_RULES)} = '' AS fine FROM ei) "
    + f"SELECT raw_id AS customerID, tenure, MonthlyCharges, CASE WHEN fine THEN {RULE_NOTE} END AS ticket_note, "
    + f"CASE WHEN fine THEN {RULE_TAG} END AS primary_sentiment_tag FROM ok",
)
def enrichment_of_dirty_rows(spark, sf):
    """Rows that break the input contract keep NULL results."""
    return enrich(stand_in.event_records(spark, sf)).select(fv.ID, "tenure", "MonthlyCharges", fv.NOTE, fv.TAG)


@query("stream_enrichment", ENRICHED + _ENRICHED_OUT)
def stream_enrichment(spark, sf):
    """The incremental job over files, run twice; the second run adds nothing."""
    source, output, checkpoint = (new_folder(spark, name) for name in ("requests", "enriched", "progress"))
    raw, finished = stand_in.customers(spark, sf), stand_in.finished_notes(spark, sf)
    resume.with_finished(raw, finished).write.parquet(source)
    arriving = spark.read.parquet(source).schema

    def run():
        requests = spark.readStream.schema(arriving).option("maxFilesPerTrigger", 4).parquet(source)
        enrich_stream(requests, output, checkpoint).awaitTermination()

    run()
    run()
    done = spark.read.parquet(f"{output}/done")
    return done.select(fv.ID, F.md5(fv.NOTE).alias("note_digest"), fv.TAG)


@query(
    "stream_keeps_rows",
    EVENT_RECORDS
    + ", ei AS (SELECT event_id, customerID AS raw_id, "
    + ", ".join(f"coalesce({c}, 'nan') AS {c}" if isinstance(d, str) else c for c, d in fv.ENRICHMENT_DEFAULTS.items())
    + f" FROM er), ok AS (SELECT *, {errors_sql(list(fv.ENRICHMENT_DEFAULTS), _EVENT_INPUT_RULES)} = '' AS fine FROM ei) "
    + "SELECT CASE WHEN fine THEN 'done' ELSE 'pending' END AS state, raw_id IS NOT NULL AS named, count(*) AS n FROM ok GROUP BY ALL",
)
def stream_keeps_rows(spark, sf):
    """Every row of a dirty stream is either done or pending, also after a second run."""
    source, output, checkpoint = (new_folder(spark, name) for name in ("dirty", "enriched", "progress"))
    stand_in.event_records(spark, sf).write.parquet(source)
    arriving = spark.read.parquet(source).schema

    def run():
        requests = spark.readStream.schema(arriving).option("maxFilesPerTrigger", 4).parquet(source)
        enrich_stream(requests, output, checkpoint).awaitTermination()

    run()
    run()
    done = spark.read.parquet(f"{output}/done").select(fv.ID, F.lit("done").alias("state"))
    left = open_rows(spark, output).select(fv.ID, F.lit("pending").alias("state"))
    both = done.unionByName(left)
    return both.groupBy("state", F.col(fv.ID).isNotNull().alias("named")).agg(F.count(F.lit(1)).alias("n"))


# --- checks on notes and tags --------------------------------------------------------------


@query(
    "tag_label_crosstab",
    ENRICHED + "SELECT primary_sentiment_tag, count(*) FILTER (Churn = 'No') AS \"no\", count(*) FILTER (Churn = 'Yes') AS yes "
    "FROM e GROUP BY 1",
)
def tag_label_crosstab(spark, sf):
    return tags.tag_label_crosstab(enriched(spark, sf))


_RATES = """SELECT primary_sentiment_tag, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM e) AS share,
 CAST(count(*) FILTER (Churn = 'Yes') AS DOUBLE) / count(*) AS label_rate FROM e GROUP BY 1"""


@query("tag_rates", ENRICHED + _RATES)
def tag_rates(spark, sf):
    return tags.tag_rates(enriched(spark, sf))


@query("leakage_screen", ENRICHED + f"SELECT *, label_rate >= 0.99 OR label_rate <= 1.0 - 0.99 AS leaks FROM ({_RATES})")
def leakage_screen(spark, sf):
    return tags.leaking_tags(enriched(spark, sf))


_WORDS = ["churn", "switch", "cancel", "decision", "the", "que"]


@query(
    "leakage_words",
    ENRICHED
    + " UNION ALL ".join(
        f"SELECT '{w}' AS word, count(*) FILTER (contains(lower(ticket_note), '{w}') AND Churn = 'Yes') AS in_churned, "
        f"count(*) FILTER (contains(lower(ticket_note), '{w}') AND Churn <> 'Yes') AS in_kept FROM e"
        for w in _WORDS
    ),
)
def leakage_words(spark, sf):
    return tags.leaking_words(enriched(spark, sf), _WORDS)


@query(
    "note_diversity",
    ENRICHED + "SELECT count(ticket_note) AS notes, count(DISTINCT md5(ticket_note)) AS unique_notes, "
    "CAST(count(DISTINCT md5(ticket_note)) AS DOUBLE) / count(ticket_note) AS share, "
    "CAST(count(DISTINCT md5(ticket_note)) AS DOUBLE) / count(ticket_note) > 0.8 AS diverse FROM e",
)
def note_diversity(spark, sf):
    return tags.note_diversity(enriched(spark, sf), exact=True)


@query(
    "review_sample",
    ENRICHED + "SELECT customerID, primary_sentiment_tag FROM e "
    "WHERE CAST('0x' || substr(md5('review-42:' || customerID), 1, 8) AS BIGINT) < CAST(floor(0.1 * 4294967296) AS BIGINT)",
)
def review_sample(spark, sf):
    return tags.review_sample(enriched(spark, sf)).select(fv.ID, fv.TAG)
