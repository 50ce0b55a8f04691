"""Names, enumerations, texts and constants that results depend on.

Everything here is plain data. Columns keep their declared order because the
scoring projection, the feature layout and the report layout follow it.
"""

# --- Fixed values: declared columns ------------------------------------------

RAW_COLUMNS = {
    "customerID": "str",
    "gender": "str",
    "SeniorCitizen": "int",
    "Partner": "str",
    "Dependents": "str",
    "tenure": "int",
    "PhoneService": "str",
    "MultipleLines": "str",
    "InternetService": "str",
    "OnlineSecurity": "str",
    "OnlineBackup": "str",
    "DeviceProtection": "str",
    "TechSupport": "str",
    "StreamingTV": "str",
    "StreamingMovies": "str",
    "Contract": "str",
    "PaperlessBilling": "str",
    "PaymentMethod": "str",
    "MonthlyCharges": "float",
    "TotalCharges": "str",
    "Churn": "str",
}

NOTE = "ticket_note"
TAG = "primary_sentiment_tag"
ID = "customerID"
TARGET = "Churn"

ENRICHED_COLUMNS = {**RAW_COLUMNS, NOTE: "str", TAG: "str"}

GATE_FALLBACK_COLUMNS = [
    "customerID",
    "tenure",
    "InternetService",
    "Contract",
    "MonthlyCharges",
    "TotalCharges",
    "Churn",
]

NUMERIC_FEATURES = ["tenure", "MonthlyCharges", "TotalCharges"]

CATEGORICAL_FEATURES = [
    "gender",
    "SeniorCitizen",
    "Partner",
    "Dependents",
    "PhoneService",
    "MultipleLines",
    "InternetService",
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
    "Contract",
    "PaperlessBilling",
    "PaymentMethod",
]

SCORING_COLUMNS = NUMERIC_FEATURES + CATEGORICAL_FEATURES

DIAGNOSTIC_COLUMNS = [TAG]

STRUCTURED_PREFIXES = ("num__", "cat__")
TEXT_PREFIXES = ("nlp__",)

# --- Fixed values: enumerations -----------------------------------------------

INTERNET_SERVICES = ["DSL", "Fiber optic", "No"]
CONTRACTS = ["Month-to-month", "One year", "Two year"]
ADD_ON_VALUES = ["Yes", "No", "No internet service"]
YES_NO = ["Yes", "No"]
SENTIMENT_TAGS = [
    "Frustrated",
    "Dissatisfied",
    "Neutral",
    "Satisfied",
    "Billing Inquiry",
    "Technical Issue",
]

INTERNET_ADD_ONS = [
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
]

BINARY_MAP_COLUMNS = [
    "Partner",
    "Dependents",
    "PhoneService",
    "MultipleLines",
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
    "PaperlessBilling",
    "Churn",
]

CLASS_COUNT_FEATURES = ["InternetService", "Contract", "PaymentMethod", "TechSupport"]

# --- Fixed values: enrichment input and its defaults for absent columns ----------

ENRICHMENT_DEFAULTS = {
    "customerID": "unknown",
    "tenure": 0,
    "gender": "Female",
    "SeniorCitizen": 0,
    "Partner": "No",
    "Dependents": "No",
    "InternetService": "No",
    "OnlineSecurity": "No",
    "OnlineBackup": "No",
    "DeviceProtection": "No",
    "TechSupport": "No",
    "StreamingTV": "No",
    "StreamingMovies": "No",
    "Contract": "Month-to-month",
    "PaperlessBilling": "No",
    "PaymentMethod": "Mailed check",
    "MonthlyCharges": 0.0,
}

# A missing text cell reaches the enrichment input as this string.
MISSING_TEXT_CELL = "nan"

UPLOAD_DEFAULT_NOTE = "No note provided."
UPLOAD_ABSENT = "Please upload a CSV file."
UPLOAD_UNREADABLE = "Failed to read CSV: {}"
FORM_DEFAULT_NOTE = "No note provided"

# --- Fixed values: rule-based notes, in order of precedence ------------------------

HIGH_CHARGE = 70.0
NEW_CUSTOMER_MONTHS = 6

NOTE_FIBER_NO_SUPPORT = (
    "Cust {customerID} contacted support regarding recurring connectivity issues "
    "with their Fiber optic service. Monthly charges of ${charges} "
    "were flagged as a concern. Agent noted the absence of TechSupport "
    "on the account."
)
NOTE_HIGH_CHARGES = (
    "Cust called to inquire about their monthly invoice of ${charges}. "
    "Requested information on available promotional plans or discounts. "
    "Agent reviewed current plan details with the customer."
)
NOTE_UNPROTECTED = (
    "Cust reported intermittent issues with their {internet} connection. "
    "Agent noted the account has no OnlineSecurity or OnlineBackup services. "
    "Ticket logged for follow-up."
)
NOTE_TWO_YEAR = (
    "Cust with {tenure} months of tenure on a two-year contract called to "
    "inquire about available service upgrades. "
    "Expressed general satisfaction with current plan."
)
NOTE_NEW_CUSTOMER = (
    "New customer ({tenure} months) called with questions about their "
    "first invoice of ${charges} and service setup. "
    "Agent walked through billing cycle and available add-on services."
)
NOTE_ROUTINE = (
    "Cust with {tenure} months tenure on a {contract} contract called "
    "regarding their {internet} service plan. "
    "Agent addressed the inquiry and noted no escalation required."
)

PROFILE_TEMPLATE = """
Customer CRM Profile:
- Customer ID     : {customerID}
- Tenure          : {tenure} months
- Gender          : {gender}
- Senior Citizen  : {senior}
- Partner         : {Partner}
- Dependents      : {Dependents}
- Internet Service: {InternetService}
- Online Security : {OnlineSecurity}
- Online Backup   : {OnlineBackup}
- Device Protect. : {DeviceProtection}
- Tech Support    : {TechSupport}
- Streaming TV    : {StreamingTV}
- Streaming Movies: {StreamingMovies}
- Contract        : {Contract}
- Paperless Bill. : {PaperlessBilling}
- Payment Method  : {PaymentMethod}
- Monthly Charges : ${charges}

Write the CRM interaction note for this customer.
"""

# --- Fixed values: text tokens a pandas CSV reader takes as missing ------------------

CSV_MISSING_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# --- Fixed values: training and scoring parameters -----------------------------------

SEED = 42
TEST_SHARE = 0.15
VALIDATION_SHARE = 0.15
EMBEDDING_WIDTH = 384
TEXT_COMPONENTS = 20
FOLDS = 5
OOF_TREES = 300
STRUCTURED_TRIALS = 30
TEXT_TRIALS = 20
META_C = 1.0
META_MAX_ITER = 1000
SMOTE_NEIGHBOURS = 5
DECISION_THRESHOLD = 0.5
SCORE_DIGITS = 6
DISPLAY_DIGITS = 4
TOP_IMPORTANCES = 20

RUN_ORDER = ["structured_baseline", "nlp_baseline", "late_fusion_stacked"]
RUN_METRICS = ["recall", "precision", "f1", "roc_auc"]

SEARCH_SPACE = {
    "trees": (100, 600),
    "depth": (3, 9),
    "learning_rate": (0.01, 0.3),
    "row_share": (0.6, 1.0),
    "column_share": (0.6, 1.0),
    "min_child": (1, 10),
    "l1": (1e-8, 1.0),
    "l2": (1e-8, 1.0),
}

# --- Fixed values: monitoring limits ---------------------------------------------------

SUITE_FAILURE_LIMIT = 0.02
ROLLING_RECALL_FLOOR = 0.70
ROLLING_DAYS = 30
FALLBACK_SHARE_LIMIT = 0.10
SCORE_SHIFT_LIMIT = 0.05
LEAKAGE_RATE = 0.99
NOTE_DIVERSITY_FLOOR = 0.80
REVIEW_SHARE = 0.10

# --- Fixed values: the report of a broken gate -------------------------------------------

GATE_BROKEN = "Dataset {} failed {} expectations."
GATE_EXPECTED = "All expectations in {} must pass."

# --- Parameters: what is refused beyond a bound, and bounded samples for fitting ----------

#: Distinct values of a class column.
MAX_CLASSES = 1000
#: Distinct categories, over all columns that become dummy columns.
MAX_CATEGORIES = 5000
#: Groups whose quantiles are asked for at once.
MAX_GROUPS = 1000
#: What the registered model queries spend on a fit. The library's own defaults are FOLDS, OOF_TREES,
#: STRUCTURED_TRIALS and TEXT_TRIALS above; README states what those cost.
QUERY_FOLDS = 5
QUERY_TREES = 300
QUERY_DEPTH = 5
QUERY_MOST_TREES = 600
#: Numbers of trees at which a search judges its candidates, and the share of them that goes on.
SEARCH_RUNGS = (25, 75, 225)
SEARCH_KEEP = 1 / 3
#: Distinct minority points that oversampling broadcasts; beyond, its exact search goes by cells.
MAX_NEIGHBOUR_POINTS = 100_000
