"""Chat formatting in budgeted windows of whole turns.

Prefix sums of turn tokens cut a conversation into spans: a span ends where the
sum passes a multiple of half the room, or around a turn longer than that, so a
span never holds more than the room unless it is one long turn.  The room is what
the budget leaves beside the history and the conversation's own system turn (at
least ``system`` tokens).  Every window repeats the leading system turn, whatever
its length, and the turns of the span before that lie within the history budget,
both outside the loss mask; the assistant turns of its own span are inside.  So each assistant turn is
trained on exactly once.

Turns are marked; ``&``, ``<`` and ``[`` in roles and texts are written as
entities, so no control string of this or another template can appear in them,
and ``unescape`` restores them.  All of it is DataFrame functions.

Defined cases: null role and text count as empty; rows that repeat a turn are
turns each, ordered by turn, role, text; a null turn comes first; null conv_id is
a conversation of its own; a turn longer than the room makes a window of its own
that exceeds the budget, and so does each turn beside a system turn that leaves no
room; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<|turn|>", "<|end|>\n"
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
#: Tokens of a window, of repeated history, kept free at least for the system turn, and those a turn's marks take.
BUDGET, HISTORY, SYSTEM, MARKS = 1024, 128, 256, 4


def escape(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def estimated_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, and every other visible character, count one."""
    return F.regexp_count(text, F.lit("[A-Za-z0-9]+|[^A-Za-z0-9\\x09-\\x0D\\x20]"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, system: int = SYSTEM, tokens=estimated_tokens) -> DataFrame:
    """conv_id, window, formatted, n_context, loss: spans [start, end) of characters.

    The first ``n_context`` turns of a window repeat what other windows hold as
    their own.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    order = Window.partitionBy("conv_id").orderBy("turn", "_role", "_text")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("_role"), text.alias("_text"))
    rows = rows.withColumn("_n", (tokens(F.col("_text")) + MARKS).cast("long")).withColumns({
        "_pos": F.row_number().over(order), "_ends": F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_first": F.first(F.struct("_role", "_n")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    leads = (F.col("_pos") == 1) & (F.col("_role") == "system")
    reserved = F.greatest(F.lit(system), F.when(F.col("_first._role") == "system", F.col("_first._n")))
    half = F.greatest(F.lit(1), F.floor((budget - history - reserved) / 2))  # at 1 every turn is long: one a window
    rows = rows.withColumns({"_lead": leads, "_starts": F.col("_ends") - F.col("_n"), "_half": half}).withColumn("_long", F.col("_n") > F.col("_half"))
    previous = F.lag(F.struct("_starts", "_long", "_lead")).over(order)
    fresh = ~leads & (previous.isNull() | previous["_lead"] | F.col("_long") | previous["_long"]
                      | (F.floor(F.col("_starts") / F.col("_half")) != F.floor(previous["_starts"] / F.col("_half"))))
    rows = rows.withColumn("_span", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    # 1-based spans; a leading system turn has span 0
    whole, span = Window.partitionBy("conv_id"), Window.partitionBy("conv_id", "_span")
    rows = rows.withColumns({"_spans": F.max("_span").over(whole), "_span_ends": F.max("_ends").over(span)})
    repeats = ~F.col("_lead") & (F.col("_span") < F.col("_spans")) & (F.col("_span_ends") - F.col("_starts") <= history)
    where = F.when(F.col("_lead"), F.sequence(F.lit(1), F.greatest(F.lit(1), "_spans"))).when(
        repeats, F.array("_span", F.col("_span") + 1)).otherwise(F.array("_span"))
    # the leading system turn is the first window's own turn and context elsewhere
    placed = rows.select("conv_id", "_pos", "_role", "_text", "_lead", "_span", F.explode(where).alias("window"))
    own = F.when(F.col("_lead"), F.col("window") == 1).otherwise(F.col("window") == F.col("_span"))
    head = F.concat(F.lit(BEGIN), F.replace(escape(F.col("_role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    body = escape(F.col("_text"))
    pieces = placed.select("conv_id", "window", "_pos", own.alias("_own"), (F.col("_role") == "assistant").alias("_target"),
                           head.alias("_head"), body.alias("_body"))
    along = Window.partitionBy("conv_id", "window").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("_head") + F.length("_body") + len(END)
    pieces = pieces.withColumn("_at", F.coalesce(F.sum(size).over(along), F.lit(0)) + F.length("_head"))
    loss = F.when(F.col("_own") & F.col("_target"), F.struct(F.col("_at").cast("long").alias("start"), (F.col("_at") + F.length("_body")).cast("long").alias("end")))
    out = pieces.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("_pos", F.concat("_head", "_body", F.lit(END)).alias("t")))).alias("_parts"),
        F.sum((~F.col("_own")).cast("int")).cast("int").alias("n_context"), F.sort_array(F.collect_list(loss)).alias("loss"))
    return out.select("conv_id", F.col("window").cast("int").alias("window"), F.array_join(F.transform("_parts", lambda p: p["t"]), "").alias("formatted"),
                      "n_context", "loss")


def parsed(formatted: DataFrame) -> DataFrame:
    """Windows read back: ``turns`` (role, text) that are the window's own, ``targets``: the text under the loss mask."""
    marked = F.slice(F.split("formatted", "<\\|turn\\|>"), 2, 1_000_000_000)
    own = F.filter(marked, lambda t, i: i >= F.col("n_context"))
    def turn(t: Column) -> Column:
        header = F.substring_index(t, "\n", 1)
        body = F.substr(t, F.length(header) + 2, F.length(t) - F.length(header) - 1 - len(END))
        return F.struct(unescape(F.replace(header, F.lit("&#10;"), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    under = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "window", F.length("formatted").cast("long").alias("chars"), F.transform(own, turn).alias("turns"), under.alias("targets"))
