"""Text expressions: templates, rule-based notes, model-reply repair, labels."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.functions.numbers import money_text

WHITESPACE = " \t\n\r\x0b\x0c"


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template with ``{name}`` fields as one concat expression."""
    parts: list[Column] = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field:
            parts.append(values[field].cast("string"))
    return F.concat(*parts)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def _rules() -> list[tuple[Column | None, str, str]]:
    """(condition, note template, tag) in order of precedence; None is the default."""
    internet, contract = F.col("InternetService"), F.col("Contract")
    monthly = contract == "Month-to-month"
    return [
        ((internet == "Fiber optic") & (F.col("TechSupport") == "No") & monthly, fv.NOTE_FIBER_NO_SUPPORT, "Frustrated"),
        ((F.col("MonthlyCharges") > fv.HIGH_CHARGE) & monthly, fv.NOTE_HIGH_CHARGES, "Billing Inquiry"),
        (
            internet.isin("Fiber optic", "DSL") & (F.col("OnlineSecurity") == "No") & (F.col("OnlineBackup") == "No"),
            fv.NOTE_UNPROTECTED,
            "Technical Issue",
        ),
        (contract == "Two year", fv.NOTE_TWO_YEAR, "Satisfied"),
        (F.col("tenure") <= fv.NEW_CUSTOMER_MONTHS, fv.NOTE_NEW_CUSTOMER, "Neutral"),
        (None, fv.NOTE_ROUTINE, "Neutral"),
    ]


def _first_match(results: list[tuple[Column | None, Column]]) -> Column:
    chain: Column | None = None
    for condition, value in results:
        if condition is None:
            return chain.otherwise(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain


def charges_text() -> Column:
    """The monthly charges as printed in notes and profiles.

    Best added as a column of its own: inside the branches of a CASE the rounding
    would be compiled once per branch.
    """
    return money_text(F.col("MonthlyCharges"))


def rule_note(charges: Column) -> Column:
    """Note text from observable service fields and the printed charges; the label is never read."""
    values = {
        "customerID": F.col("customerID"),
        "charges": charges,
        "internet": F.col("InternetService"),
        "contract": F.col("Contract"),
        "tenure": F.col("tenure"),
    }
    return _first_match([(cond, fill(template, values)) for cond, template, _ in _rules()])


def rule_tag() -> Column:
    return _first_match([(cond, F.lit(tag)) for cond, _, tag in _rules()])


def profile_text(charges: Column) -> Column:
    """The customer profile handed to a note generator."""
    values = {name: F.col(name) for name in fv.ENRICHMENT_DEFAULTS}
    values["senior"] = F.when(F.col("SeniorCitizen") == 1, F.lit("Yes")).otherwise(F.lit("No"))
    values["charges"] = charges
    return fill(fv.PROFILE_TEMPLATE, values)


def strip_fences(c: Column) -> Column:
    """Remove one leading code fence of each kind and a trailing one."""
    opened = F.regexp_replace(F.regexp_replace(strip(c), r"\A```json", ""), r"\A```", "")
    return strip(F.regexp_replace(opened, r"```\z", ""))


def parse_json_whole(c: Column) -> Column:
    """Text to variant, NULL unless the text is exactly one JSON value.

    The parser stops after the first value. Inside brackets and inside braces the
    text only parses when nothing follows that value.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    single = keyed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(single, F.try_variant_get(listed, "$[0]", "variant"))


def parse_reply(raw: Column) -> Column:
    """Model reply to ``struct<ticket_note, primary_sentiment_tag>``; NULL when unusable.

    A tag given as a list is healed to its first element. Values must be JSON
    strings, the note must not be empty and the tag must be a known one.
    """
    document = parse_json_whole(strip_fences(raw))

    def text_at(path: str) -> Column:
        is_text = F.schema_of_variant(F.try_variant_get(document, path, "variant")) == "STRING"
        return F.when(is_text, F.try_variant_get(document, path, "string"))

    note = text_at("$.ticket_note")
    tag = strip(F.coalesce(text_at("$.primary_sentiment_tag[0]"), text_at("$.primary_sentiment_tag")))
    usable = (F.length(note) >= 1) & tag.isin(fv.SENTIMENT_TAGS)
    return F.when(usable, F.struct(note.alias(fv.NOTE), tag.alias(fv.TAG)))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def category_or_unknown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("Unknown"))


def run_title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def failure_label(expectation: Column, column: Column) -> Column:
    return F.concat(expectation, F.lit(" on '"), F.coalesce(column, F.lit("table")), F.lit("'"))
