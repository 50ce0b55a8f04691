"""Cleaning, encoding, defaults and column selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.functions.numbers import nan_to_null, round_exact, to_number


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def coerce_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns to double; text that does not parse becomes NULL."""
    kinds = dict(df.dtypes)
    return df.withColumns(
        {
            c: to_number(quoted(c)) if kinds[c] == "string" else nan_to_null(quoted(c).cast("double"))
            for c in columns
        }
    )


def collapse_redundant(df: DataFrame) -> DataFrame:
    """"No phone service" and "No internet service" are a plain "No"."""
    collapsed = {"MultipleLines": "No phone service", **{c: "No internet service" for c in fv.INTERNET_ADD_ONS}}
    return df.withColumns(
        {c: F.when(F.col(c) == redundant, F.lit("No")).otherwise(F.col(c)) for c, redundant in collapsed.items()}
    )


def binary_map(c: Column, one: str, zero: str) -> Column:
    """1 / 0 for the two named values, NULL for anything else."""
    return F.when(c == one, F.lit(1)).when(c == zero, F.lit(0)).cast("long")


def map_binaries(df: DataFrame) -> DataFrame:
    mapped = {c: binary_map(F.col(c), "Yes", "No") for c in fv.BINARY_MAP_COLUMNS}
    return df.withColumns({**mapped, "gender": binary_map(F.col("gender"), "Female", "Male")})


def drop_missing(df: DataFrame) -> DataFrame:
    """Rows without any missing cell; NaN counts as missing."""
    return df.na.drop("any")


def model_inputs(df: DataFrame) -> DataFrame:
    """Drop identifier, target and diagnostic columns before fitting."""
    return df.drop(fv.ID, fv.TARGET, *fv.DIAGNOSTIC_COLUMNS)


def prefixed_columns(df: DataFrame, prefixes: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def encode_target(c: Column) -> Column:
    return F.when(c == "Yes", 1).otherwise(0).cast("long")


def scoring_projection(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The 19 scoring columns in fixed order; a missing total is a blank."""
    chosen = [
        F.coalesce(F.col("TotalCharges").cast("string"), F.lit("")).alias("TotalCharges") if c == "TotalCharges" else F.col(c)
        for c in fv.SCORING_COLUMNS
    ]
    return df.select(*(keep or []), *chosen)


def default_note_column(df: DataFrame) -> DataFrame:
    """Add the default note only when the column itself is absent."""
    return df if fv.NOTE in df.columns else df.withColumn(fv.NOTE, F.lit(fv.UPLOAD_DEFAULT_NOTE))


def enrichment_inputs(df: DataFrame) -> DataFrame:
    """The observable fields of the enrichment input.

    An absent column takes its default; a missing text cell becomes the text a
    missing cell prints as; a missing number stays NULL and fails the contract.
    """
    columns = {}
    for name, default in fv.ENRICHMENT_DEFAULTS.items():
        if name not in df.columns:
            columns[name] = F.lit(default).cast("long") if isinstance(default, int) else F.lit(default)
        elif isinstance(default, str):
            columns[name] = F.coalesce(F.col(name).cast("string"), F.lit(fv.MISSING_TEXT_CELL))
        elif isinstance(default, int):
            columns[name] = F.col(name).try_cast("long")
        else:
            columns[name] = F.col(name).try_cast("double")
    return df.withColumns(columns)


def add_note_columns(df: DataFrame) -> DataFrame:
    absent = [c for c in (fv.NOTE, fv.TAG) if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else df


def normalise_form(df: DataFrame) -> DataFrame:
    """Free form input: a senior flag outside 0/1 is 0, blanks are missing, no note gets the default."""
    senior = F.col("SeniorCitizen").cast("string")
    blank_to_null = {c: F.nullif(F.col(c), F.lit("")) for c in (fv.ID, "TotalCharges")}
    return df.withColumns(
        {
            "SeniorCitizen": F.when(senior.isin("0", "1"), senior.try_cast("long")).otherwise(F.lit(0).cast("long")),
            "tenure": F.col("tenure").try_cast("long"),
            **blank_to_null,
            fv.NOTE: F.coalesce(F.nullif(F.col(fv.NOTE), F.lit("")), F.lit(fv.FORM_DEFAULT_NOTE)),
        }
    )


def display_scores(scores: DataFrame) -> DataFrame:
    """Scored rows as shown to a reader."""

    def shown(name: str) -> Column:
        return round_exact(F.coalesce(F.col(name), F.lit(0.0)), fv.DISPLAY_DIGITS)

    return scores.select(
        F.col(fv.ID).alias("Customer ID"),
        F.when(F.col("churn_prediction"), F.lit("Yes")).otherwise(F.lit("No")).alias("Churn Prediction"),
        shown("churn_probability").alias("Probability"),
        shown("p_structured").alias("Structured Branch"),
        shown("p_nlp").alias("NLP Branch"),
    )


def first_rows(df: DataFrame, limit: int | None, key: str = fv.ID) -> DataFrame:
    """The first ``limit`` rows by ``key``; 0 or None keeps all."""
    return df.orderBy(key).limit(limit) if limit else df
