"""Exploratory statistics, measures and monitors."""

from __future__ import annotations

from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.catalog.data_checks import collapsed_sql, enriched
from staywise.catalog.registry import query
from staywise.catalog.sql_views import CUSTOMERS, RISK, RUNS
from staywise.functions.text import run_title
from staywise.operators import explore, measures, ranking
from staywise.plans import stand_in
from staywise.session import new_folder, written
from staywise.sources import reports
from staywise.streaming.monitors import daily_tallies, latest_tallies, rolling_monitors, tallies_stream


@query("class_counts", CUSTOMERS + "SELECT Churn, count(*) AS n FROM v GROUP BY Churn")
def class_counts(spark, sf):
    return explore.class_counts(stand_in.customers(spark, sf))


@query(
    "imbalance_ratio",
    "SELECT max(n) AS majority, min(n) AS minority, CAST(max(n) AS DOUBLE) / min(n) AS ratio "
    "FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)",
)
def imbalance_ratio(spark, sf):
    return explore.imbalance_ratio(stand_in.table(spark, sf, "lineitem"), "l_returnflag")


def _counts_sql(source, features, label):
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS value, {label}, count(*) AS n FROM {source} GROUP BY ALL" for f in features
    )


@query("feature_class_counts", CUSTOMERS + _counts_sql("v", fv.CLASS_COUNT_FEATURES, "Churn"))
def feature_class_counts(spark, sf):
    return explore.feature_class_counts(stand_in.customers(spark, sf), fv.CLASS_COUNT_FEATURES)


_LINE_FEATURES = ["l_linestatus", "l_linenumber"]


@query("line_class_counts", _counts_sql("lineitem", _LINE_FEATURES, "l_returnflag"))
def line_class_counts(spark, sf):
    return explore.feature_class_counts(stand_in.table(spark, sf, "lineitem"), _LINE_FEATURES, "l_returnflag")


def _boxplot_sql(source, columns, label):
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT '{c}' AS feature, q.{label}, n, q1, median, q3,
            (SELECT min(x) FROM {source} s, LATERAL (SELECT CAST(s.{c} AS DOUBLE) AS x) WHERE s.{label} = q.{label} AND x >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
            (SELECT max(x) FROM {source} s, LATERAL (SELECT CAST(s.{c} AS DOUBLE) AS x) WHERE s.{label} = q.{label} AND x <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
            (SELECT count(*) FROM {source} s, LATERAL (SELECT CAST(s.{c} AS DOUBLE) AS x) WHERE s.{label} = q.{label}
               AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))) AS outliers
            FROM (SELECT {label}, count({c}) AS n, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
                         quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3
                  FROM {source} GROUP BY {label}) q"""
        )
    body = " UNION ALL ".join(parts)
    names = ["q1", "median", "q3", "whisker_low", "whisker_high"]
    return f"SELECT feature, {label}, n, outliers, " + ", ".join(f"round({c}, 4) AS {c}" for c in names) + f" FROM ({body})"


def _rounded_boxes(boxes):
    return boxes.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")})


@query(
    "boxplot_stats",
    CUSTOMERS
    + ", c AS (SELECT * REPLACE (TRY_CAST(TotalCharges AS DOUBLE) AS TotalCharges) FROM v) "
    + _boxplot_sql("c", fv.NUMERIC_FEATURES, "Churn"),
)
def boxplot_stats(spark, sf):
    numbers = explore.coerce_numbers(stand_in.customers(spark, sf), ["TotalCharges"])
    return _rounded_boxes(explore.boxplot_stats(numbers, fv.NUMERIC_FEATURES, fv.TARGET))


_LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("boxplot_lines", _boxplot_sql("lineitem", _LINE_NUMBERS, "l_returnflag"))
def boxplot_lines(spark, sf):
    lines = stand_in.table(spark, sf, "lineitem")
    return _rounded_boxes(explore.boxplot_stats(lines, _LINE_NUMBERS, "l_returnflag"))


@query(
    "line_medians",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.9), 4) AS p90 FROM lineitem"
        for c in _LINE_NUMBERS
    ),
)
def line_medians(spark, sf):
    fitted = ranking.exact_quantiles(stand_in.table(spark, sf, "lineitem"), _LINE_NUMBERS, [0.5, 0.9])
    rows = [(f["feature"], f["count"], *map(float, f["quantiles"])) for f in fitted]
    table = spark.createDataFrame(rows, "feature string, n bigint, median double, p90 double")
    return table.withColumns({"median": F.round("median", 4), "p90": F.round("p90", 4)})


def _corr_sql(source, columns):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM {source}"
        for a in columns
        for b in columns
    )


_LINE_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("line_correlation", _corr_sql("lineitem", _LINE_CORR))
def line_correlation(spark, sf):
    matrix = explore.correlation_matrix(stand_in.table(spark, sf, "lineitem"), _LINE_CORR)
    return matrix.withColumn("corr", F.round("corr", 6))


_CODED = ["tenure", "MonthlyCharges", "TotalCharges", "Partner", "OnlineSecurity", "Churn"]


@query(
    "customer_correlation",
    CUSTOMERS
    + ", c AS (SELECT tenure, MonthlyCharges, TRY_CAST(TotalCharges AS DOUBLE) AS TotalCharges, "
    + "CASE Partner WHEN 'Yes' THEN 1 ELSE 0 END AS Partner, CASE OnlineSecurity WHEN 'Yes' THEN 1 ELSE 0 END AS OnlineSecurity, "
    + "CASE Churn WHEN 'Yes' THEN 1 ELSE 0 END AS Churn FROM v WHERE TRY_CAST(TotalCharges AS DOUBLE) IS NOT NULL) "
    + _corr_sql("c", _CODED),
)
def customer_correlation(spark, sf):
    coded = explore.cleaned_for_exploration(stand_in.customers(spark, sf))
    return explore.correlation_matrix(coded, _CODED).withColumn("corr", F.round("corr", 6))


_ENCODED_SQL = {
    "gender": "CASE gender WHEN 'Female' THEN 1 WHEN 'Male' THEN 0 END",
    **{c: c for c in ("SeniorCitizen", "tenure", "MonthlyCharges")},
    "TotalCharges": "TRY_CAST(TotalCharges AS DOUBLE)",
    **{c: f"CASE {collapsed_sql(c)} WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END" for c in fv.BINARY_MAP_COLUMNS},
    **{
        f"{c}_{v}": f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END"
        for c, values in (
            ("InternetService", ("Fiber optic", "No")),
            ("Contract", ("One year", "Two year")),
            ("PaymentMethod", ("Credit card (automatic)", "Electronic check", "Mailed check")),
        )
        for v in values
    },
}


@query(
    "correlation_matrix",
    CUSTOMERS
    + ", c AS (SELECT "
    + ", ".join(f"CAST({value} AS DOUBLE) AS k{i}" for i, value in enumerate(_ENCODED_SQL.values()))
    + " FROM v WHERE TRY_CAST(TotalCharges AS DOUBLE) IS NOT NULL) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr(k{i}, k{j}), 6) AS corr FROM c"
        for i, a in enumerate(_ENCODED_SQL)
        for j, b in enumerate(_ENCODED_SQL)
    ),
)
def correlation_matrix(spark, sf):
    """All encoded columns, dummies included."""
    encoded = explore.drop_first_dummies(explore.cleaned_for_exploration(stand_in.customers(spark, sf)), [fv.ID])
    return explore.correlation_matrix(encoded, encoded.columns).withColumn("corr", F.round("corr", 6))


def _vif_sql() -> str:
    """The inverse of the scaled Gram matrix by Gauss and Jordan, a pivot at a time; its diagonal is the VIF."""
    features = {c: value for c, value in _ENCODED_SQL.items() if c != fv.TARGET}
    p = len(features)
    cells = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, sum(k{i} * k{j}) AS v FROM c" for i in range(p) for j in range(p))
    steps = [
        "c AS MATERIALIZED (SELECT " + ", ".join(f"CAST({value} AS DOUBLE) AS k{i}" for i, value in enumerate(features.values())) + " FROM v WHERE TRY_CAST(TotalCharges AS DOUBLE) IS NOT NULL)",
        f"g AS MATERIALIZED ({cells})",
        "a0 AS MATERIALIZED (SELECT g.i, g.j, g.v / sqrt(x.v * y.v) AS v FROM g JOIN g AS x ON x.i = g.i AND x.j = g.i JOIN g AS y ON y.i = g.j AND y.j = g.j)",
    ]
    for k in range(p):
        steps.append(
            f"""a{k + 1} AS MATERIALIZED (SELECT m.i, m.j, CASE WHEN m.i = {k} AND m.j = {k} THEN 1 / o.v WHEN m.i = {k} THEN m.v / o.v WHEN m.j = {k} THEN -m.v / o.v
                ELSE m.v - c.v * r.v / o.v END AS v FROM a{k} AS m JOIN a{k} AS r ON r.i = {k} AND r.j = m.j JOIN a{k} AS c ON c.j = {k} AND c.i = m.i JOIN a{k} AS o ON o.i = {k} AND o.j = {k})"""
        )
    names = ", ".join(f"({i}, '{c}')" for i, c in enumerate(features))
    return CUSTOMERS + ", " + ",\n".join(steps) + f" SELECT name AS Feature, round(v, 4) AS VIF FROM a{p} JOIN (VALUES {names}) AS f(pos, name) ON i = pos AND j = pos"


@query("vif", _vif_sql())
def vif(spark, sf):
    cleaned = explore.cleaned_for_exploration(stand_in.customers(spark, sf))
    encoded = explore.drop_first_dummies(cleaned, [fv.ID, fv.TARGET])
    result = written(explore.variance_inflation(encoded, encoded.columns), "vif")
    path = new_folder(spark, "vif")
    reports.write_vif(result, path)
    return spark.read.schema("Feature string, VIF double").option("header", "true").csv(path).withColumn("VIF", F.round("VIF", 4))


@query(
    "line_vif",
    """WITH g AS (SELECT sum(l_quantity * l_quantity) AS aa, sum(l_extendedprice * l_extendedprice) AS bb,
                         sum(l_discount * l_discount) AS cc, sum(l_quantity * l_extendedprice) AS ab,
                         sum(l_quantity * l_discount) AS ac, sum(l_extendedprice * l_discount) AS bc FROM lineitem),
       d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM g)
       SELECT 'l_quantity' AS Feature, round(aa * (bb * cc - bc * bc) / det, 6) AS VIF FROM d
       UNION ALL SELECT 'l_extendedprice', round(bb * (aa * cc - ac * ac) / det, 6) FROM d
       UNION ALL SELECT 'l_discount', round(cc * (aa * bb - ab * ab) / det, 6) FROM d""",
)
def line_vif(spark, sf):
    """Three columns, where the inverse of the Gram matrix has a closed form."""
    result = explore.variance_inflation(stand_in.table(spark, sf, "lineitem"), _LINE_NUMBERS)
    return result.withColumn("VIF", F.round("VIF", 6))


@query(
    "vif_collinear",
    """WITH g AS (SELECT sum(l_quantity * l_quantity) AS aa, sum(l_discount * l_discount) AS cc, sum(l_quantity * l_discount) AS ac FROM lineitem)
       SELECT 'quantity' AS Feature, CAST('inf' AS DOUBLE) AS VIF FROM g
       UNION ALL SELECT 'twice', CAST('inf' AS DOUBLE) FROM g
       UNION ALL SELECT 'none', CAST(NULL AS DOUBLE) FROM g
       UNION ALL SELECT 'discount', round(cc / (cc - ac * ac / aa), 6) FROM g""",
)
def vif_collinear(spark, sf):
    """A column that another one determines, one of zeros, and one that stands for itself."""
    quantity = F.col("l_quantity").cast("double")
    lines = stand_in.table(spark, sf, "lineitem").select(
        quantity.alias("quantity"), (2 * quantity).alias("twice"), F.lit(0.0).alias("none"), F.col("l_discount").alias("discount")
    )
    result = explore.variance_inflation(lines, lines.columns)
    return result.withColumn("VIF", F.round("VIF", 6))


@query(
    "drop_first_dummies",
    CUSTOMERS + """SELECT customerID, CAST(tenure AS DOUBLE) AS tenure,
      CASE WHEN InternetService = 'Fiber optic' THEN 1.0::DOUBLE ELSE 0 END AS "InternetService_Fiber optic",
      CASE WHEN InternetService = 'No' THEN 1.0::DOUBLE ELSE 0 END AS InternetService_No,
      CASE WHEN Contract = 'One year' THEN 1.0::DOUBLE ELSE 0 END AS "Contract_One year",
      CASE WHEN Contract = 'Two year' THEN 1.0::DOUBLE ELSE 0 END AS "Contract_Two year" FROM v""",
)
def drop_first_dummies(spark, sf):
    chosen = stand_in.customers(spark, sf).select(fv.ID, "tenure", "InternetService", "Contract")
    return explore.drop_first_dummies(chosen, [fv.ID], keep=[fv.ID])


# --- classification measures ------------------------------------------------------------------


@query("confusion_matrix", RUNS + "SELECT * FROM conf")
def confusion_matrix(spark, sf):
    return measures.confusion_matrix(stand_in.rule_runs(enriched(spark, sf)), ["run"])


_METRICS = "SELECT run, " + ", ".join(f"round({m}, 9) AS {m}" for m in fv.RUN_METRICS)


def _rounded(df, names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@query("metric_suite", RUNS + _METRICS + " FROM metrics")
def metric_suite(spark, sf):
    return _rounded(measures.metric_suite(stand_in.rule_runs(enriched(spark, sf)), ["run"]), fv.RUN_METRICS)


@query(
    "line_auc",
    """WITH s AS (SELECT l_linestatus, l_extendedprice AS score, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS pos,
                         sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS neg FROM lineitem GROUP BY 1, 2),
       r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY l_linestatus ORDER BY score
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
       SELECT l_linestatus, round(sum(pos * (before + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 9) AS roc_auc
       FROM r GROUP BY 1""",
)
def line_auc(spark, sf):
    """Nearly as many distinct scores as rows."""
    rows = stand_in.table(spark, sf, "lineitem").select(
        "l_linestatus",
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.col("l_extendedprice").alias("probability"),
    )
    return _rounded(measures.roc_auc(rows, ["l_linestatus"]), ["roc_auc"])


_LIFT = """SELECT m.run, round(CASE WHEN m.run = 'late_fusion_stacked' THEN m.recall - s.recall END, 9) AS recall_lift,
 round(CASE WHEN m.run = 'late_fusion_stacked' THEN m.f1 - s.f1 END, 9) AS f1_lift
 FROM metrics m, metrics s WHERE s.run = 'structured_baseline'"""


@query("lift", RUNS + _LIFT)
def lift(spark, sf):
    lifted = measures.with_lift(measures.metric_suite(stand_in.rule_runs(enriched(spark, sf)), ["run"]))
    return _rounded(lifted.select("run", "recall_lift", "f1_lift"), ["recall_lift", "f1_lift"])


@query(
    "run_comparison",
    RUNS
    + f""", lifts AS ({_LIFT})
    SELECT CAST(CASE m.run WHEN 'structured_baseline' THEN 0 WHEN 'nlp_baseline' THEN 1 ELSE 2 END AS BIGINT) AS position,
           CASE m.run WHEN 'structured_baseline' THEN 'Structured Baseline' WHEN 'nlp_baseline' THEN 'Nlp Baseline'
                ELSE 'Late Fusion Stacked' END AS "Model Architecture",
           round(recall, 4) AS "Recall", round(precision, 4) AS "Precision", round(f1, 4) AS "F1 Score", round(roc_auc, 4) AS "ROC AUC",
           round(recall_lift, 4) AS "Recall Lift vs Baseline", round(f1_lift, 4) AS "F1 Lift vs Baseline"
    FROM metrics m JOIN lifts ON lifts.run = m.run""",
)
def run_comparison(spark, sf):
    """The nested report is written, read back and laid out as a table."""
    lifted = measures.with_lift(measures.metric_suite(stand_in.rule_runs(enriched(spark, sf)), ["run"]))
    path = new_folder(spark, "evaluation")
    reports.write_evaluation(reports.nest_evaluation(lifted, "r1", {"target_column": fv.TARGET, "cv_folds": "5"}), path)
    return reports.read_evaluation(spark, path)


@query(
    "run_titles",
    "SELECT DISTINCT event_type, CASE event_type WHEN 'signup' THEN 'Signup Run' WHEN 'view' THEN 'View Run' "
    "WHEN 'click' THEN 'Click Run' WHEN 'error' THEN 'Error Run' ELSE 'Purchase Run' END AS title FROM events",
)
def run_titles(spark, sf):
    kinds = stand_in.table(spark, sf, "events").select("event_type").distinct()
    return kinds.withColumn("title", run_title(F.concat("event_type", F.lit("_run"))))


@query(
    "confusion_rates",
    RUNS
    + """SELECT run, tp, fn, fp, tn, round(CAST(tp AS DOUBLE) / (tp + fn), 9) AS recall,
      round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 9) AS precision,
      round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1,
      round(CAST(fp AS DOUBLE) / (fp + tn), 9) AS fp_rate,
      round(coalesce(CAST((SELECT fp FROM conf WHERE run = 'structured_baseline') - fp AS DOUBLE)
            / nullif((SELECT fp FROM conf WHERE run = 'structured_baseline'), 0), 0), 9) AS fp_reduction FROM conf""",
)
def confusion_rates(spark, sf):
    confusion = measures.confusion_matrix(stand_in.rule_runs(enriched(spark, sf)), ["run"])
    reduced = measures.false_positive_reduction(confusion)
    return _rounded(reduced, ["recall", "precision", "f1", "fp_rate", "fp_reduction"])


@query(
    "at_risk_customers",
    RISK + "SELECT customerID, probability FROM r ORDER BY probability DESC, customerID LIMIT 100",
)
def at_risk_customers(spark, sf):
    risk = stand_in.risk_points(stand_in.customers(spark, sf)).select(fv.ID, "probability")
    return measures.top_risk(risk, 100, "probability")


_THRESHOLDS = [0.2, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7]


@query(
    "threshold_sweep",
    RISK
    + ", t AS (SELECT unnest([0.2::DOUBLE, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7]) AS threshold), "
    + """c AS (SELECT threshold, count(*) FILTER (label = 1 AND probability >= threshold) AS tp,
       count(*) FILTER (label = 1 AND probability < threshold) AS fn,
       count(*) FILTER (label = 0 AND probability >= threshold) AS fp,
       count(*) FILTER (label = 0 AND probability < threshold) AS tn FROM r, t GROUP BY threshold)
       SELECT threshold, tp, fn, fp, tn, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 9) AS recall,
       round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 9) AS precision,
       round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1,
       round(coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0), 9) AS fp_rate FROM c""",
)
def threshold_sweep(spark, sf):
    swept = measures.threshold_sweep(stand_in.risk_points(stand_in.customers(spark, sf)), _THRESHOLDS)
    return _rounded(swept, ["recall", "precision", "f1", "fp_rate"])


@query(
    "group_fairness",
    RISK
    + ", l AS (SELECT 'gender' AS attribute, gender AS value, label, prediction FROM r "
    + "UNION ALL SELECT 'SeniorCitizen', CAST(SeniorCitizen AS VARCHAR), label, prediction FROM r), "
    + """c AS (SELECT attribute, value, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 1 AND prediction = 0) AS fn,
       count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 0 AND prediction = 0) AS tn FROM l GROUP BY ALL)
       SELECT *, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 9) AS tp_rate,
       round(coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0), 9) AS fp_rate FROM c""",
)
def group_fairness(spark, sf):
    rated = measures.group_fairness(stand_in.risk_points(stand_in.customers(spark, sf)), ["gender", "SeniorCitizen"])
    return _rounded(rated, ["tp_rate", "fp_rate"])


_PSI_BOUNDS = [10.0, 20.0, 30.0, 40.0]


@query(
    "stability_index",
    """WITH c AS (SELECT CAST(least(floor(l_quantity / 10), 4) AS BIGINT) AS bin,
                 count(*) FILTER (l_shipdate >= TIMESTAMP '1999-01-01') AS actual,
                 count(*) FILTER (NOT l_shipdate >= TIMESTAMP '1999-01-01') AS expected FROM lineitem GROUP BY 1),
       s AS (SELECT bin, greatest(coalesce(actual / nullif(sum(actual) OVER (), 0), 0), 1e-4) AS actual_share,
                    greatest(coalesce(expected / nullif(sum(expected) OVER (), 0), 0), 1e-4) AS expected_share FROM c)
       SELECT bin, round(actual_share, 9) AS actual_share, round(expected_share, 9) AS expected_share,
              round((actual_share - expected_share) * ln(actual_share / expected_share), 9) AS part FROM s""",
)
def stability_index(spark, sf):
    lines = stand_in.table(spark, sf, "lineitem")
    recent = F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp")
    parts = measures.stability_index(lines, "l_quantity", recent, _PSI_BOUNDS)
    return _rounded(parts, ["actual_share", "expected_share", "part"])


# --- monitors ------------------------------------------------------------------------------------

_MONITORS = """
WITH x AS (SELECT ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS label,
                  least(value / 200.0::DOUBLE, 1.0) AS probability, user_id % 9 <> 0 AS up FROM events),
d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS scored, sum(probability) AS score_sum, count(*) FILTER (NOT up) AS fallbacks,
             count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 1 AND probability >= 0.1) AS hits FROM x GROUP BY 1),
m AS (SELECT day, scored,
        coalesce(CAST(sum(hits) OVER w AS DOUBLE) / nullif(sum(positives) OVER w, 0), 0) AS rolling_recall,
        CAST(fallbacks AS DOUBLE) / scored AS fallback_share,
        score_sum / scored - sum(score_sum) OVER () / sum(scored) OVER () AS score_shift
      FROM d WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW))
SELECT day, scored, round(rolling_recall, 9) AS rolling_recall, round(fallback_share, 9) AS fallback_share,
       round(score_shift, 9) AS score_shift, rolling_recall < 0.7 AS recall_alarm, fallback_share > 0.1 AS fallback_alarm,
       abs(score_shift) > 0.05 AS shift_alarm FROM m"""


def _rounded_monitors(daily):
    return _rounded(rolling_monitors(daily), ["rolling_recall", "fallback_share", "score_shift"])


@query("monitor_windows", _MONITORS)
def monitor_windows(spark, sf):
    return _rounded_monitors(daily_tallies(stand_in.scored_events(spark, sf)))


@query("stream_monitors", _MONITORS)
def stream_monitors(spark, sf):
    """The daily tallies come from a stream in event time; the calendar is then rolled up."""
    path, checkpoint = new_folder(spark, "daily"), new_folder(spark, "progress")
    # The supplied file is one table, so it is matched as a one-file glob.
    schema = stand_in.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    tallies_stream(stand_in.scored_from(events), path, checkpoint).awaitTermination()
    return _rounded_monitors(latest_tallies(spark.read.parquet(path)))


@query(
    "late_tallies",
    """
WITH x AS (SELECT CAST(ts AS DATE) AS day, coalesce(user_id % 10 = 0, false) AS held FROM events),
mark AS (SELECT max(day) AS mark FROM x WHERE NOT held)
SELECT day, count(*) AS scored, count(*) FILTER (held AND day < mark - INTERVAL 1 DAY) AS late FROM x, mark GROUP BY day""",
)
def late_tallies(spark, sf):
    """A tenth of the users' events arrives after all others: their days are corrected, and late rows counted."""
    source, path, progress = (new_folder(spark, n) for n in ("events", "daily", "progress"))
    events = stand_in.table(spark, sf, "events")
    for held in (False, True):
        events.where(F.coalesce(F.col("user_id") % 10 == 0, F.lit(False)) == F.lit(held)).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(events.schema).parquet(source)
        tallies_stream(stand_in.scored_from(arriving), path, progress).awaitTermination()
    return latest_tallies(spark.read.parquet(path)).select("day", "scored", "late")
