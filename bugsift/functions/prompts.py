"""Prompt construction, transcripts and reply parsing for triple extraction.

A prompt is ``array<struct<role:string, content:string>>`` built with column
expressions. The texts come from a ``PromptTemplates`` value, which callers may
replace as a whole or in part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = "struct<role:string,content:string>"


@dataclass(frozen=True)
class PromptTemplates:
    """Texts of the prompt styles; each is used as it stands around the report."""

    instruction: str = ("Read the tester's note and give back one line <scene, operation, defect>. "
                        "Write error when one of the three cannot be told. Note: ")
    suffix: str = (" -- Give the note above back as one line <scene, operation, defect>, "
                   "or the word error when one of the three cannot be told.")
    example_report: str = "On the parcel map, pinching to zoom out leaves the courier pin floating off the road."
    example_triple: str = "<parcel map, pinch to zoom out, courier pin floats off the road>"
    persona: str = ("You triage notes from testers. Every message holds one note; your whole answer is "
                    "<scene, operation, defect> or error.")
    persona_ack: str = "Ready for the first note."
    persona_example: str = " For instance, {report} becomes {triple}"
    sentence: str = ("Each message is a single sentence about where a tester was, what they did and what went "
                     "wrong. Reduce it to <scene, operation, defect>, or to error if a part is missing. "
                     "Sentences do not belong together.")
    sentence_ack: str = "Ready for the first sentence."
    refine: str = "Somewhere in this answer is a triple. Copy it out alone as <scene;operation;defect>: "
    refine_example: str = ("Scene - ticket machine. Operation - pay by card, then cancel. "
                           "Defect - receipt prints anyway, twice.")
    refine_triple: str = "<ticket machine;pay by card, then cancel;receipt prints anyway, twice>"
    chain_context: str = ("Below are the words on a screen and a tester's note about it. Some questions follow; "
                          "answer each in one short line. Words and note: ")
    chain_ack: str = "Ask away."
    chain_questions: tuple[str, ...] = (
        "Which part of the product does the note speak about?",
        "What goes wrong there?",
        "What was the tester doing when it went wrong?",
        "Now put your three answers together as <scene, operation, defect>.",
    )
    screenshot_label: str = "[screen] "
    report_label: str = "\n[note] "


TEMPLATES = PromptTemplates()
CHAIN_QUESTIONS = list(TEMPLATES.chain_questions)

# Remarks without information, for the (optional) perturbation step.
PHRASES = [
    "Just my impression, though.", "I was on the train at the time.", "Not sure anyone else minds.",
    "My old phone never did that.", "Please look into it when you can.", "I tried it before lunch.",
    "It felt odd.", "A colleague shrugged at it.", "Thanks for the hard work otherwise!",
    "This happened on a rainy day.",
]


def message(role: str | Column, content: str | Column) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    c = F.lit(content) if isinstance(content, str) else content
    return F.struct(r.alias("role"), c.cast("string").alias("content"))


def fuse_text(report: Column, image_text: Column, style: str = "labelled",
              templates: PromptTemplates = TEMPLATES) -> Column:
    """Text + screenshot fusion: ``bare`` = image text then report; ``labelled`` =
    each after its label; ``report`` = report only."""
    rep, img = F.coalesce(report, F.lit("")), F.coalesce(image_text, F.lit(""))
    if style == "bare":
        return F.concat(img, rep)
    if style == "labelled":
        return F.concat(F.lit(templates.screenshot_label), img, F.lit(templates.report_label), rep)
    if style == "report":
        return rep
    raise ValueError(f"unknown fusion style {style!r}")


def build_prompt(text: Column, style: str, templates: PromptTemplates = TEMPLATES) -> Column:
    """The message list for one report under a prompt style."""
    t, p = F.coalesce(text, F.lit("")), templates
    user = lambda *parts: message("user", F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]))
    reply = lambda x: message("assistant", x)
    role_example = p.persona_example.format(report=p.example_report, triple=p.example_triple)
    styles = {
        "prefix_zero_shot": [user(p.instruction, t)],
        "prefix_one_shot": [user(p.instruction, p.example_report), reply(p.example_triple), user(p.instruction, t)],
        "suffix_zero_shot": [user(t, p.suffix)],
        "suffix_one_shot": [user(p.example_report, p.suffix), reply(p.example_triple), user(t, p.suffix)],
        "role_zero_shot": [user(p.persona), reply(p.persona_ack), user(t)],
        "role_one_shot": [user(p.persona, role_example), reply(p.persona_ack), user(t)],
        "sentence": [user(p.sentence), reply(p.sentence_ack), user(t)],
        "refine_zero_shot": [user(p.refine, t)],
        "refine_one_shot": [user(p.refine, p.refine_example), reply(p.refine_triple), user(p.refine, t)],
        "chain": [user(p.chain_context, t), reply(p.chain_ack), user(p.chain_questions[0])],
    }
    if style not in styles:
        raise ValueError(f"unknown prompt style {style!r}; one of {sorted(styles)}")
    return F.array(*styles[style])


def append_turn(messages: Column, role: str | Column, content: str | Column) -> Column:
    """The transcript with one more message at the end."""
    return F.concat(messages, F.array(message(role, content)))


def build_transcripts(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn",
                      role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, messages)`` from a turn table, messages in turn order.

    One conversation becomes one row because it is one request; its size is
    bounded by the model's context, not by the corpus."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("t"), F.col(role_col).alias("role"),
                                                   F.col(text_col).alias("content"))))
    return turns.groupBy(conv_col).agg(
        F.transform(ordered, lambda e: F.struct(e["role"].alias("role"), e["content"].alias("content")))
        .alias("messages"))


def flatten_messages(df: DataFrame, key_cols: list[str], messages_col: str = "messages") -> DataFrame:
    """``(keys..., pos, role, content)``: one row per message."""
    return df.select(*key_cols, F.posexplode(messages_col).alias("pos", "m")).select(
        *key_cols, F.col("pos").cast("int").alias("pos"), "m.role", "m.content")


def pick_phrase(key: Column, seed: str = "0", phrases: list[str] | None = None) -> Column:
    """Deterministic choice of a phrase: first 32 bits of md5(seed || key)."""
    ph = phrases or PHRASES
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*[F.lit(p) for p in ph]), (F.pmod(h, F.lit(len(ph))) + 1).cast("int"))


def perturb_text(text: Column, key: Column, seed: str = "0", phrases: list[str] | None = None) -> Column:
    """Text with one subjective phrase appended (deterministic per key)."""
    return F.concat(F.coalesce(text, F.lit("")), pick_phrase(key, seed, phrases))


# A triple whose parts are split by semicolons, else by commas
# (ASCII or full width); the last part may hold more separators of its kind.
SEMICOLON_TRIPLE = r"<([^;；<>]+)[;；]([^;；<>]+)[;；]([^<>]+)>"
COMMA_TRIPLE = r"<([^，,;；<>]+)[，,]([^，,;；<>]+)[，,]([^;；<>]+)>"


def parse_triple(reply: Column) -> Column:
    """``struct(status, scene, operation, defect)``; status in ok / error / blank / malformed.

    A triple that holds semicolons is split at these alone, so its parts may
    hold commas."""
    r = F.coalesce(reply, F.lit(""))
    semi, comma = r.rlike(SEMICOLON_TRIPLE), r.rlike(COMMA_TRIPLE)
    status = (F.when(semi | comma, F.lit("ok"))
              .when(F.trim(r) == "", F.lit("blank"))
              .when(F.lower(r).contains("error"), F.lit("error"))
              .otherwise(F.lit("malformed")))
    part = lambda k: (F.when(semi, F.trim(F.regexp_extract(r, SEMICOLON_TRIPLE, k)))
                      .when(comma, F.trim(F.regexp_extract(r, COMMA_TRIPLE, k))))
    return F.struct(status.alias("status"), part(1).alias("scene"), part(2).alias("operation"),
                    part(3).alias("defect"))


def encode_fixed_length(tokens: DataFrame, vocab: DataFrame, *, id_col: str, n: int = 50,
                        tokens_col: str = "tokens", vocab_bound: int | None = None,
                        overflow: str = "chunks") -> DataFrame:
    """Fixed-length model input: ``(id, chunk, input_ids array<int>, attention_mask array<int>)``.

    Ids: 0 = padding, 1 = unknown, term_idx + 2 otherwise. ``overflow='chunks'``
    (default) encodes the whole text as consecutive windows of ``n`` tokens
    (chunk 0, 1, ...; a text without tokens gives one all-padding chunk);
    ``'truncate'`` keeps only chunk 0, the classic truncating encoder.
    The vocabulary is broadcast only under a known size bound (``vocab_bound``,
    e.g. the vectoriser's ``max_features``); otherwise AQE decides at run time."""
    from ..operators.features import BROADCAST_TERMS
    if overflow not in ("chunks", "truncate"):
        raise ValueError("overflow must be 'chunks' or 'truncate'")
    toks = F.col(tokens_col) if overflow == "chunks" else F.slice(tokens_col, 1, n)
    ex = tokens.select(id_col, F.posexplode(toks).alias("pos", "term"))
    v = vocab.select("term", "term_idx")
    if vocab_bound is not None and vocab_bound <= BROADCAST_TERMS:
        v = F.broadcast(v)
    ids = ex.join(v, "term", "left").select(
        id_col, (F.col("pos") / n).cast("long").alias("chunk"), "pos",
        F.coalesce(F.col("term_idx") + 2, F.lit(1)).cast("int").alias("tid"))
    # a chunk holds n tokens: grouping (id, chunk) is bounded by n, and reuses the id partitioning
    grouped = ids.groupBy(id_col, "chunk").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "tid"))), lambda e: e["tid"]).alias("ids"))
    empty = tokens.where(F.coalesce(F.size(tokens_col), F.lit(0)) <= 0).select(
        id_col, F.lit(0).cast("long").alias("chunk"), F.array().cast("array<int>").alias("ids"))
    full = grouped.unionByName(empty)
    pad = lambda arr, val: F.concat(arr, F.array_repeat(F.lit(val), F.lit(n) - F.size(arr)))
    return full.select(id_col, "chunk", pad(F.col("ids"), 0).alias("input_ids"),
                       pad(F.transform("ids", lambda _: F.lit(1)), 0).alias("attention_mask"))
