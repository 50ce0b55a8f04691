"""Shared SQL for the DuckDB twins: the derived customer tables as common table expressions."""

from __future__ import annotations

from string import Formatter

from staywise import fixed_values as fv


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def filled(template: str, values: dict[str, str]) -> str:
    parts = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(text(literal))
        if field:
            parts.append(values[field])
    return "concat(" + ", ".join(parts) + ")"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def _add_on(name: str, position: int) -> str:
    return (
        f"CASE WHEN InternetService = 'No' THEN 'No internet service' "
        f"WHEN substr(h, {position}, 1) < '8' THEN 'No' ELSE 'Yes' END AS {name}"
    )


CUSTOMERS = f"""
WITH b AS (
  SELECT c_name AS customerID,
         (c_custkey * 7) % 73 AS tenure,
         1825 + (c_custkey * 37) % 10150 AS cents,
         CASE c_custkey % 3 WHEN 0 THEN 'Fiber optic' WHEN 1 THEN 'DSL' ELSE 'No' END AS InternetService,
         CASE WHEN c_custkey % 11 < 6 THEN 'Month-to-month'
              WHEN c_custkey % 11 < 8 THEN 'One year' ELSE 'Two year' END AS Contract,
         md5('addon:' || CAST(c_custkey AS VARCHAR)) AS h,
         substr(md5('churn:' || CAST(c_custkey AS VARCHAR)), 1, 4) AS u
  FROM customer),
v AS (
  SELECT customerID,
         CASE WHEN substr(h, 4, 1) < '8' THEN 'Female' ELSE 'Male' END AS gender,
         CAST(CASE WHEN substr(h, 5, 1) < '3' THEN 1 ELSE 0 END AS BIGINT) AS SeniorCitizen,
         CASE WHEN substr(h, 6, 1) < '8' THEN 'Yes' ELSE 'No' END AS Partner,
         CASE WHEN substr(h, 7, 1) < '5' THEN 'Yes' ELSE 'No' END AS Dependents,
         tenure,
         CASE WHEN substr(h, 8, 1) < 'e' THEN 'Yes' ELSE 'No' END AS PhoneService,
         CASE WHEN substr(h, 8, 1) >= 'e' THEN 'No phone service'
              WHEN substr(h, 9, 1) < '7' THEN 'Yes' ELSE 'No' END AS MultipleLines,
         InternetService,
         {_add_on("OnlineSecurity", 2)},
         {_add_on("OnlineBackup", 3)},
         {_add_on("DeviceProtection", 10)},
         {_add_on("TechSupport", 1)},
         {_add_on("StreamingTV", 11)},
         {_add_on("StreamingMovies", 12)},
         Contract,
         CASE WHEN substr(h, 13, 1) < '9' THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
         CASE WHEN substr(h, 14, 1) < '4' THEN 'Electronic check'
              WHEN substr(h, 14, 1) < '8' THEN 'Mailed check'
              WHEN substr(h, 14, 1) < 'c' THEN 'Bank transfer (automatic)'
              ELSE 'Credit card (automatic)' END AS PaymentMethod,
         CAST(cents AS DOUBLE) / 100 AS MonthlyCharges,
         CASE WHEN tenure = 0 THEN ' '
              ELSE concat(CAST((tenure * cents) // 100 AS VARCHAR), '.',
                          lpad(CAST((tenure * cents) % 100 AS VARCHAR), 2, '0')) END AS TotalCharges,
         CASE WHEN (Contract = 'Month-to-month' AND u < '6b85') OR u < '1400' THEN 'Yes' ELSE 'No' END AS Churn
  FROM b)
"""

FINISHED = CUSTOMERS + """,
ex AS (
  SELECT 'Customer#' || lpad(CAST(d.doc_id AS VARCHAR), 9, '0') AS customerID,
         d.text AS ticket_note,
         CASE WHEN l.toxic = 1 THEN 'Frustrated'
              WHEN l.quality = 0 THEN 'Dissatisfied'
              WHEN l.quality = 1 THEN 'Satisfied' END AS primary_sentiment_tag
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
j AS (SELECT v.*, ex.ticket_note, ex.primary_sentiment_tag FROM v LEFT JOIN ex ON v.customerID = ex.customerID)
"""

MONEY = "printf('%.2f', MonthlyCharges)"
_NOTE_VALUES = {
    "customerID": "customerID",
    "charges": MONEY,
    "internet": "InternetService",
    "contract": "Contract",
    "tenure": "CAST(tenure AS VARCHAR)",
}
_FIBER = "InternetService = 'Fiber optic' AND TechSupport = 'No' AND Contract = 'Month-to-month'"
_HIGH = "MonthlyCharges > 70.0 AND Contract = 'Month-to-month'"
_BARE = "InternetService IN ('Fiber optic', 'DSL') AND OnlineSecurity = 'No' AND OnlineBackup = 'No'"

RULE_NOTE = f"""CASE WHEN {_FIBER} THEN {filled(fv.NOTE_FIBER_NO_SUPPORT, _NOTE_VALUES)}
  WHEN {_HIGH} THEN {filled(fv.NOTE_HIGH_CHARGES, _NOTE_VALUES)}
  WHEN {_BARE} THEN {filled(fv.NOTE_UNPROTECTED, _NOTE_VALUES)}
  WHEN Contract = 'Two year' THEN {filled(fv.NOTE_TWO_YEAR, _NOTE_VALUES)}
  WHEN tenure <= 6 THEN {filled(fv.NOTE_NEW_CUSTOMER, _NOTE_VALUES)}
  ELSE {filled(fv.NOTE_ROUTINE, _NOTE_VALUES)} END"""

RULE_TAG = f"""CASE WHEN {_FIBER} THEN 'Frustrated' WHEN {_HIGH} THEN 'Billing Inquiry'
  WHEN {_BARE} THEN 'Technical Issue' WHEN Contract = 'Two year' THEN 'Satisfied' ELSE 'Neutral' END"""

_PENDING = "ticket_note IS NULL OR primary_sentiment_tag IS NULL"

ENRICHED = FINISHED + f""",
e AS (SELECT * REPLACE (
        CASE WHEN {_PENDING} THEN {RULE_NOTE} ELSE ticket_note END AS ticket_note,
        CASE WHEN {_PENDING} THEN {RULE_TAG} ELSE primary_sentiment_tag END AS primary_sentiment_tag)
      FROM j)
"""

_RISK = """
       CAST(CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS BIGINT) AS label,
       CAST(CASE Contract WHEN 'Month-to-month' THEN 45 WHEN 'One year' THEN 20 ELSE 5 END
            + CASE InternetService WHEN 'Fiber optic' THEN 20 WHEN 'DSL' THEN 10 ELSE 0 END
            + CASE WHEN tenure <= 12 THEN 15 ELSE 0 END AS DOUBLE) / 100 AS probability"""

RISK = CUSTOMERS + f""",
r AS (SELECT *, CAST(CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS prediction
      FROM (SELECT customerID, gender, SeniorCitizen, {_RISK} FROM v))
"""

RUNS = ENRICHED + f""",
s AS (SELECT customerID, {_RISK}, CAST(length(ticket_note) % 100 AS DOUBLE) / 100 AS p_nlp FROM e),
u3 AS (SELECT 'structured_baseline' AS run, customerID, label, probability FROM s
       UNION ALL SELECT 'nlp_baseline', customerID, label, p_nlp FROM s
       UNION ALL SELECT 'late_fusion_stacked', customerID, label, (probability + p_nlp) / 2 FROM s),
runs AS (SELECT *, CAST(CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS prediction FROM u3),
conf AS (SELECT run, count(*) FILTER (label = 1 AND prediction = 1) AS tp,
                count(*) FILTER (label = 1 AND prediction = 0) AS fn,
                count(*) FILTER (label = 0 AND prediction = 1) AS fp,
                count(*) FILTER (label = 0 AND prediction = 0) AS tn
         FROM runs GROUP BY run),
byscore AS (SELECT run, probability, sum(label) AS pos, sum(1 - label) AS neg FROM runs GROUP BY run, probability),
ranked AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY run ORDER BY probability
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM byscore),
auc AS (SELECT run, sum(pos * (before + neg / 2.0)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS roc_auc
        FROM ranked GROUP BY run),
metrics AS (SELECT conf.run, CAST(tp AS DOUBLE) / (tp + fn) AS recall,
                   coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
                   coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, roc_auc
            FROM conf JOIN auc ON conf.run = auc.run)
"""

_CHOICE = (
    "CASE user_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 2 THEN 'No internet service' ELSE 'maybe' END"
)
_YES_NO = "CASE WHEN user_id % 2 = 0 THEN 'Yes' ELSE 'No' END"

EVENT_RECORDS = f"""
WITH er AS (
  SELECT CASE WHEN event_type <> 'error' THEN 'E' || CAST(event_id AS VARCHAR) END AS customerID,
         CASE event_type WHEN 'signup' THEN 'Female' WHEN 'view' THEN 'Male' END AS gender,
         user_id % 3 AS SeniorCitizen,
         {_YES_NO} AS Partner, {_YES_NO} AS Dependents,
         CAST(floor(value) AS BIGINT) - 5 AS tenure,
         {_YES_NO} AS PhoneService, {_YES_NO} AS MultipleLines,
         CASE user_id % 5 WHEN 0 THEN 'DSL' WHEN 1 THEN 'Fiber optic' WHEN 2 THEN 'No' WHEN 3 THEN 'Cable' END AS InternetService,
         {", ".join(f"{_CHOICE} AS {c}" for c in fv.INTERNET_ADD_ONS)},
         CASE WHEN user_id % 7 < 3 THEN 'Month-to-month' WHEN user_id % 7 < 5 THEN 'One year' ELSE 'Two year' END AS Contract,
         {_YES_NO} AS PaperlessBilling,
         'Mailed check' AS PaymentMethod,
         value - 2 AS MonthlyCharges,
         CASE WHEN event_type <> 'click' THEN printf('%.2f', value) END AS TotalCharges,
         CASE event_type WHEN 'purchase' THEN 'No' WHEN 'error' THEN 'Maybe' ELSE 'Yes' END AS Churn,
         event_id
  FROM events)
"""


def errors_sql(required: list[str], rules: list[tuple[str, str]]) -> str:
    """Broken rules joined by '; ', as the contracts list them."""
    parts = [f"CASE WHEN {c} IS NULL THEN '{c}: missing' END" for c in required]
    parts += [f"CASE WHEN {test} THEN {text(message)} END" for message, test in rules]
    return "concat_ws('; ', " + ", ".join(parts) + ")"


RANGE_RULES = [
    ("SeniorCitizen: outside 0..1", "SeniorCitizen < 0 OR SeniorCitizen > 1"),
    ("tenure: outside 0..", "tenure < 0"),
    ("MonthlyCharges: outside 0..", "MonthlyCharges < 0"),
]


def one_of_sql(column: str, values: list[str]) -> tuple[str, str]:
    return f"{column}: not an allowed value", f"{column} NOT IN {in_list(values)}"
