r"""Chat formatting by event-sourced reconstruction (native: SQL functions only).

``fold_events`` rebuilds conversations from an event log (conversation,
sequence number, kind, turn, role, text): ``message`` opens a turn, ``delta``
appends to it, ``edit`` replaces it, ``regenerate`` empties it so that following
deltas refill it. A message, edit or regeneration of turn t voids what the log
held before it on turn t and on every later turn. A turn's text is its last
opening event's text and the deltas after it, in sequence order; its role is
the last role given.

``render`` writes a conversation as one string::

    ### role: text</turn>\n

Inside roles and texts ``\``, ``<`` and ``#`` become ``\e``, ``\l`` and ``\h``
(and ``:`` in roles ``\c``), so neither mark can occur in them and reading back
is exact. The loss mask is a list of (start, length) spans in code points over
the string: one for each assistant text that is not empty.

Nulls: a null text is empty, a null role is the empty role, events without a
conversation or a sequence number form conversation null / come first. Equal
sequence numbers are ordered by turn, kind and text. Repeated events count as
often as they are logged. A conversation is one row of the result, so its own
length bounds that row; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("#", "\\h"))


def _replace(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column, role: bool = False) -> Column:
    out = _replace(c, ESCAPES)
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(c: Column, role: bool = False) -> Column:
    if role:
        c = F.replace(c, F.lit("\\c"), F.lit(":"))
    return _replace(c, [(b, a) for a, b in reversed(ESCAPES)])


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the turns that stand at the end of the log.

    ``events``: conv_id, seq, kind, turn, role, text; other columns are ignored."""
    prepare(events.sparkSession)
    order = ["seq", "turn", "kind", "text"]
    e = events.select("conv_id", "seq", "kind", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    opens = F.col("kind").isin("message", "edit", "regenerate")
    later = (Window.partitionBy("conv_id").orderBy(*[F.col(c).desc() for c in order])
             .rowsBetween(Window.unboundedPreceding, -1))
    voided = F.min(F.when(opens, F.col("turn"))).over(later)
    live = e.withColumn("_void", voided).where(F.col("_void").isNull() | (F.col("turn") < F.col("_void")))
    parts = live.groupBy("conv_id", "turn").agg(
        F.array_sort(F.collect_list(F.struct("seq", "turn", "kind", "text"))).alias("_parts"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct(*order))).alias("role"))
    return parts.select("conv_id", "turn", "role",
                        F.concat_ws("", F.transform("_parts", lambda p: p["text"])).alias("text"))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<start,length>>) from turns."""
    prepare(turns.sparkSession)
    role = F.coalesce("role", F.lit(""))
    t = turns.select(
        "conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text")).select(
        "conv_id", "turn", "role",
        F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(MID)).alias("_head"),
        escape(F.col("text")).alias("_body"))
    before = (Window.partitionBy("conv_id").orderBy("turn", "role", "_body")
              .rowsBetween(Window.unboundedPreceding, -1))
    size = F.length("_head") + F.length("_body") + len(CLOSE)
    t = t.withColumn("_at", F.coalesce(F.sum(size).over(before), F.lit(0)))
    span = F.when((F.col("role") == LOSS_ROLE) & (F.col("_body") != ""),
                  F.struct((F.col("_at") + F.length("_head")).alias("start"),
                           F.length("_body").cast("long").alias("length")))
    grouped = t.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "_at", F.concat("_head", "_body", F.lit(CLOSE)).alias("_s"), span.alias("_span")))).alias("_t"))
    return grouped.select(
        "conv_id", F.concat_ws("", F.transform("_t", lambda x: x["_s"])).alias("formatted"),
        F.filter(F.transform("_t", lambda x: x["_span"]), lambda x: x.isNotNull()).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and masked texts of rendered conversations: (conv_id, pos, role,
    text, loss). Only ``formatted`` and ``loss_spans`` are read."""
    pieces = formatted.select(
        "conv_id", F.length("formatted").cast("long").alias("_all"),
        F.posexplode(F.split("formatted", CLOSE)).alias("pos", "_s")).where("_s <> ''")
    at = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    p = pieces.select(
        "conv_id", "pos", "_all",
        F.expr(f"substring(_s, {len(OPEN) + 1}, instr(_s, '{MID}') - {len(OPEN) + 1})").alias("_role"),
        F.expr(f"substring(_s, instr(_s, '{MID}') + {len(MID)})").alias("_text"),
        (F.instr("_s", MID) + len(MID) - 1).alias("_head"), F.length("_s").alias("_len"))
    p = p.withColumn("_start", (F.coalesce(F.sum(F.col("_len") + len(CLOSE)).over(at), F.lit(0))
                                + F.col("_head")).cast("long"))
    spans = formatted.select(F.col("conv_id").alias("_c"), F.explode("loss_spans").alias("_x")).select(
        "_c", F.col("_x.start").alias("_from"), F.col("_x.length").alias("_size"))
    same = (F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_start") == F.col("_from"))
            & (F.length("_text") == F.col("_size")))
    return p.join(spans, same, "left").select(
        "conv_id", "pos", unescape(F.col("_role"), role=True).alias("role"),
        unescape(F.col("_text")).alias("text"), F.col("_size").isNotNull().alias("loss"),
        F.col("_all").alias("formatted_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """One row per rendered conversation, from what is read back."""
    back = read_back(formatted).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.max("formatted_chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("pos", "role", "text", "loss"))).alias("_t"))
    both = F.concat_ws("", F.transform("_t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    lost = F.concat_ws("", F.transform(F.filter("_t", lambda x: x["loss"]), lambda x: x["text"]))
    return back.select(
        "conv_id", "n_turns", F.sha2(both.cast("binary"), 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
