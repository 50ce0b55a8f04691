"""Row contracts: every row gets the list of rules it breaks; none is raised."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise import fixed_values as fv

class Rule(NamedTuple):
    """What a broken row is told, the columns it takes, and a test.

    Columns can only be built while a session is active, so the test is a function.
    """

    message: str
    columns: tuple[str, ...]
    broken: Callable[[], Column]


@dataclass(frozen=True)
class Contract:
    """Required columns plus (message, violated-when) rules."""

    name: str
    required: tuple[str, ...]
    rules: tuple[Rule, ...] = ()


def _range(column: str, low: float | None = None, high: float | None = None) -> Rule:
    def broken() -> Column:
        c = F.col(column)
        # NaN is above every number in Spark's order, so it is named explicitly.
        test = F.isnan(c.cast("double"))
        if low is not None:
            test = test | (c < low)
        if high is not None:
            test = test | (c > high)
        return test

    bounds = f"{'' if low is None else low}..{'' if high is None else high}"
    return Rule(f"{column}: outside {bounds}", (column,), broken)


def _one_of(column: str, values: list[str]) -> Rule:
    return Rule(f"{column}: not an allowed value", (column,), lambda: ~F.col(column).isin(values))


def _lift_missing(column: str) -> Rule:
    return Rule(f"{column}: missing", ("run", column), lambda: (F.col("run") == fv.RUN_ORDER[2]) & F.col(column).isNull())


_CUSTOMER_RANGES = (_range("SeniorCitizen", 0, 1), _range("tenure", 0), _range("MonthlyCharges", 0))

CUSTOMER_ROW = Contract(
    "customer_row", tuple(c for c in fv.RAW_COLUMNS if c != "TotalCharges"), _CUSTOMER_RANGES
)

# Note and tag are optional, so the rules are those of the raw row.
ENRICHED_ROW = Contract("enriched_row", CUSTOMER_ROW.required, CUSTOMER_ROW.rules)

ENRICHMENT_INPUT = Contract(
    "enrichment_input",
    tuple(fv.ENRICHMENT_DEFAULTS),
    (
        *_CUSTOMER_RANGES,
        _one_of("InternetService", fv.INTERNET_SERVICES),
        *[_one_of(c, fv.ADD_ON_VALUES) for c in fv.INTERNET_ADD_ONS],
        _one_of("Contract", fv.CONTRACTS),
    ),
)

NOTE_OUTPUT = Contract(
    "note_output",
    (fv.NOTE, fv.TAG),
    (Rule("ticket_note: empty", (fv.NOTE,), lambda: F.length(fv.NOTE) < 1), _one_of(fv.TAG, fv.SENTIMENT_TAGS)),
)

SCORE_REQUEST = Contract(
    "score_request",
    tuple(c for c in fv.SCORING_COLUMNS if c != "TotalCharges") + (fv.NOTE,),
    _CUSTOMER_RANGES,
)

SCORE_RESPONSE = Contract(
    "score_response",
    ("churn_probability", "churn_prediction", "p_structured", "p_nlp", "nlp_branch_available", "model_version"),
    (_range("churn_probability", 0, 1), _range("p_structured", 0, 1), _range("p_nlp", 0, 1)),
)


def vector_contract(column: str = "embedding", width: str = "dim") -> Contract:
    return Contract(
        "vector_table",
        (column, width),
        (
            Rule(f"{width}: not positive", (width,), lambda: F.col(width) <= 0),
            Rule(f"{column}: length is not {width}", (column, width), lambda: F.size(column) != F.col(width)),
        ),
    )


EVALUATION_ROW = Contract(
    "evaluation_row",
    ("run", *fv.RUN_METRICS),
    (
        _one_of("run", fv.RUN_ORDER),
        *[_range(m, 0, 1) for m in fv.RUN_METRICS],
        _lift_missing("recall_lift"),
        _lift_missing("f1_lift"),
    ),
)


def with_errors(df: DataFrame, contract: Contract) -> DataFrame:
    """Add ``errors array<string>``; columns the contract does not name pass through.

    An absent column is one error of every row and silences only the rules that need it.
    """
    present = [c for c in contract.required if c in df.columns]
    absent = [c for c in contract.required if c not in df.columns]
    messages = [F.lit(f"{c}: missing") for c in absent]
    messages += [F.when(F.col(c).isNull(), F.lit(f"{c}: missing")) for c in present]
    messages += [F.when(r.broken(), F.lit(r.message)) for r in contract.rules if set(r.columns) <= set(df.columns)]
    return df.withColumn("errors", F.filter(F.array(*messages), lambda m: m.isNotNull()))


def keeps(df: DataFrame, contract: Contract) -> Column:
    """True where a row breaks no rule: the verdict alone, as plain comparisons."""
    if any(c not in df.columns for c in contract.required):
        return F.lit(False)
    complete = [F.col(c).isNotNull() for c in contract.required]
    unbroken = [~F.coalesce(r.broken(), F.lit(False)) for r in contract.rules]
    return reduce(and_, [*complete, *unbroken])


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") == 0).drop("errors")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") > 0)


def scored_table_check(requests: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: how many requests and scores, and whether each request has exactly one score.

    Both sides are counted by id first, so one hot id is one row in the join.
    """
    asked = requests.groupBy(fv.ID).agg(F.count(F.lit(1)).alias("asked"))
    answered = scores.groupBy(fv.ID).agg(F.count(F.lit(1)).alias("answered"))
    sides = asked.join(answered, asked[fv.ID].eqNullSafe(answered[fv.ID]), "full")
    return sides.agg(
        F.coalesce(F.sum("asked"), F.lit(0)).alias("requests"),
        F.coalesce(F.sum("answered"), F.lit(0)).alias("total"),
        F.coalesce(F.bool_and(F.col("asked").eqNullSafe(F.col("answered"))), F.lit(True)).alias("consistent"),
    )
