"""Chat formatting from an event log, in DataFrame operations only.

A log has one row per event: conversation, turn, seq, kind, role, text. ``delta`` adds text to
its turn. ``edit`` and ``regenerate`` start the turn anew with their own text, and take back
what was said in later turns before them (the conversation forks there). Folding a log sorts
each conversation by seq, drops what was taken back and joins what is left of each turn; the
rendering puts the turns into one string and tells which characters carry loss.

Template. A turn is ``<s>`` body ``</s>``. A user's body is ``[INST] text [/INST]``, an
assistant's is the text alone, any other role's is ``[ROLE] name [/ROLE]text``. Inside texts and
names a backslash is doubled and every control string gets a backslash after its first
character, so no text can end a turn; ``read_turns`` undoes both.

One shuffle, by conversation: all windows and both groupings share it. A conversation becomes
one string, so a conversation of any length must fit into one cell; it passes through one task,
whose sort spills.

Cases: a null text is empty; a null kind is ``delta``; a null role is the empty role; null
conversation ids form one conversation; events of one seq follow the order of their texts; a
turn of which nothing is left is no turn; repeated rows are events of their own; an empty log
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROL = r"([<\[])(/?(?:s>|INST\]|ROLE\]))"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """The turns that are left: conv_id, turn, role, text. Columns as in the module's text."""
    log = events.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.col("seq").cast("long").alias("seq"),
        F.coalesce(F.col("kind"), F.lit("delta")).alias("kind"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    restart = F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    marked = log.withColumn("fork", F.max(restart).over(earlier)).withColumn("restart", F.max(restart).over(Window.partitionBy("conv_id", "turn")))
    current = (F.col("restart").isNull() | (F.col("seq") >= F.col("restart"))) & (F.col("fork").isNull() | (F.col("seq") > F.col("fork")))
    said = F.sort_array(F.collect_list(F.struct("seq", "text", "role")))
    turns = marked.filter(current).groupBy("conv_id", "turn").agg(said.alias("said"))
    return turns.select("conv_id", "turn", F.get("said", 0)["role"].alias("role"), F.array_join(F.col("said.text"), "").alias("text"))


def render(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, mask: a row per conversation.

    ``mask`` lists the characters under loss: their start in ``formatted`` and number, and the
    same start as turn number and offset within that turn's ``<s>`` body.
    """
    role, text = F.col("role"), escape(F.col("text"))
    named = F.concat(F.lit("[ROLE] "), escape(role), F.lit(" [/ROLE]"))
    head = F.when(role == "user", F.lit("[INST] ")).when(role == "assistant", F.lit("")).otherwise(named)
    tail = F.when(role == "user", F.lit(" [/INST]")).otherwise(F.lit(""))
    pieces = turns.select("conv_id", "turn", "role", F.concat(F.lit("<s>"), head).alias("head"), text.alias("body"), F.concat(tail, F.lit("</s>")).alias("tail"))
    pieces = pieces.select("conv_id", "turn", "role", "body", F.concat("head", "body", "tail").alias("piece"), F.char_length("head").alias("offset"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.select(
        "conv_id",
        "turn",
        "piece",
        F.when(
            role == loss_role,
            F.struct(
                (F.coalesce(F.sum(F.char_length("piece")).over(so_far), F.lit(0)) + F.col("offset")).alias("start"),
                F.char_length("body").alias("chars"),
                (F.row_number().over(order) - 1).alias("piece"),
                F.col("offset"),
            ),
        ).alias("span"),
    )
    gathered = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "piece", "span"))).alias("all"))
    return gathered.select(
        "conv_id",
        F.size("all").cast("long").alias("n_turns"),
        F.array_join(F.col("all.piece"), "").alias("formatted"),
        F.filter(F.col("all.span"), lambda s: s.isNotNull()).alias("mask"),
    )


def read_pieces(formatted: Column) -> Column:
    """The turns of a rendered string as they stand in it, without their ends."""
    parts = F.split(formatted, "</s>")
    return F.slice(parts, 1, F.size(parts) - 1)


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered string, unescaped."""

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(4))
        close = F.instr(body, " [/ROLE]")
        return (
            F.when(body.startswith("[INST] "), F.struct(F.lit("user").alias("role"), unescape(F.substr(body, F.lit(8), F.char_length(body) - 15)).alias("text")))
            .when(
                body.startswith("[ROLE] "),
                F.struct(unescape(F.substr(body, F.lit(8), close - 8)).alias("role"), unescape(F.substr(body, close + 8)).alias("text")),
            )
            .otherwise(F.struct(F.lit("assistant").alias("role"), unescape(body).alias("text")))
        )

    return F.transform(read_pieces(formatted), turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, unescaped, in order and with nothing between."""
    from staywise.llm.common import bind

    cut = lambda pieces: F.transform(mask, lambda s: unescape(F.substr(F.get(pieces, s["piece"]), s["offset"] + 1, s["chars"])))
    return F.array_join(bind(read_pieces(formatted), cut), "")
