"""Enrichment: resume, validate, generate, fall back, write back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.functions.plugins import built_once, factory_key
from staywise.functions.text import charges_text, parse_reply, profile_text, rule_note, rule_tag
from staywise.operators.clean import add_note_columns, enrichment_inputs, first_rows
from staywise.operators.contracts import ENRICHMENT_INPUT, keeps
from staywise.operators.resume import is_pending, with_finished
from staywise.session import ship_code

# A generator factory builds, once per Python worker, a function from profile texts to raw replies.
GeneratorFactory = Callable[[], Callable[[list[str]], list[str | None]]]


def reply_column(factory: GeneratorFactory) -> Callable[[Column, Column], Column]:
    """A column function ``(profile, wanted) -> raw reply``; failures give NULL, unwanted rows are not sent."""
    ship_code()
    key = factory_key(factory)

    @F.pandas_udf("string")
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for profiles, wanted in batches:
            replies = pd.Series([None] * len(profiles), index=profiles.index, dtype=object)
            chosen = wanted.fillna(False).astype(bool)
            if chosen.any():
                try:
                    replies[chosen] = built_once(factory, key)(profiles[chosen].tolist())
                except Exception:
                    replies[chosen] = None
            yield replies

    return ask


def generate_notes(
    inputs: DataFrame,
    wanted: Column,
    primary: GeneratorFactory | str | None = None,
    secondary: GeneratorFactory | str | None = None,
) -> DataFrame:
    """Add ``new_note``, ``new_tag`` and ``source``; all NULL where ``wanted`` is not true.

    The first usable reply wins: primary, then secondary, then the rules. Each tier
    is asked only for rows the earlier ones left open. A tier is a generator, or the name
    of a column with raw replies that were collected before.
    """
    table = inputs.withColumns({"_wanted": F.coalesce(wanted, F.lit(False)), "_charges": charges_text()})
    charges = F.col("_charges")
    tiers: list[tuple[str, Column]] = []
    open_rows = F.col("_wanted")
    for name, factory in (("primary", primary), ("secondary", secondary)):
        if factory is not None:
            collected = isinstance(factory, str)
            raw = F.when(open_rows, F.col(factory)) if collected else reply_column(factory)(profile_text(charges), open_rows)
            table = table.withColumn(f"_{name}", raw)
            table = table.withColumn(f"_{name}", parse_reply(F.col(f"_{name}")))
            tiers.append((name, F.col(f"_{name}")))
            open_rows = open_rows & F.col(f"_{name}").isNull()
    source = F.lit("rules")
    for name, reply in reversed(tiers):
        source = F.when(reply.isNotNull(), F.lit(name)).otherwise(source)
    note = F.coalesce(*[reply[fv.NOTE] for _, reply in tiers], rule_note(charges))
    tag = F.coalesce(*[reply[fv.TAG] for _, reply in tiers], rule_tag())
    # Separate columns, so that a reader of the tags alone never builds the notes.
    new = {"new_note": note, "new_tag": tag, "source": source}
    table = table.withColumns({c: F.when(F.col("_wanted"), value) for c, value in new.items()})
    return table.drop("_wanted", "_charges", *[f"_{name}" for name, _ in tiers])


def enrich_pending(
    table: DataFrame,
    primary: GeneratorFactory | None = None,
    secondary: GeneratorFactory | None = None,
    pending: str | None = None,
) -> DataFrame:
    """Fill note and tag of pending rows; rows that break the input contract stay pending.

    A narrow plan: no shuffle after the resume join. Adds ``source`` (NULL: not
    generated). ``pending`` names a column that already tells which rows are.
    """
    table = add_note_columns(table)
    names = [c for c in table.columns if c != pending]
    # The fields handed to a generator take the plain names; the row as it came is kept beside them.
    original = {c: f"_raw_{c}" for c in names if c in fv.ENRICHMENT_DEFAULTS}
    inputs = enrichment_inputs(table.withColumns({kept: F.col(c) for c, kept in original.items()}))
    todo = F.col(pending) if pending else is_pending()
    done = generate_notes(inputs, todo & keeps(inputs, ENRICHMENT_INPUT), primary, secondary)
    generated = F.col("source").isNotNull()
    final = {c: F.col(original.get(c, c)) for c in names}
    final[fv.NOTE] = F.when(generated, F.col("new_note")).otherwise(F.col(fv.NOTE))
    final[fv.TAG] = F.when(generated, F.col("new_tag")).otherwise(F.col(fv.TAG))
    return done.select(*[final[c].alias(c) for c in names], "source")


def enrich(
    raw: DataFrame,
    finished: DataFrame | None = None,
    limit: int | None = None,
    primary: GeneratorFactory | None = None,
    secondary: GeneratorFactory | None = None,
) -> DataFrame:
    """The enriched table: finished rows as they are, pending rows generated; finished ids must be unique."""
    table = add_note_columns(first_rows(raw, limit))
    if finished is None:
        return enrich_pending(table, primary, secondary)
    return enrich_pending(with_finished(table, finished, "_pending"), primary, secondary, "_pending")
