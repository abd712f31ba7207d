"""Batch completion: send each row's messages to a completer, keep the reply.

The completer is user code (a hosted model client, a local model...). It is
built once per task by ``completer_factory()`` and called on slices of Arrow batches:
``complete(list_of_message_lists) -> list[str | None]``; ``None`` or an
exception marks a failed item. Failed items are retried up to ``retries``
more times; what still fails gets ``default`` and status ``'failed'``. A
completer with an attribute ``attempt`` is told the number of the attempt.
Rows whose messages are null are failed without a call.
Output is keyed by id (at-least-once: a re-run task recomputes its rows).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..session import cut_lineage

Completer = Callable[[list[list[dict]]], list]
# most messages of one call: what a task holds as Python objects
CALL_ROWS = 512


def _to_messages(arr) -> list[dict] | None:
    return None if arr is None else [{"role": m["role"], "content": m["content"]} for m in arr]


def batch_complete(df: DataFrame, *, id_col: str, messages_col: str = "messages",
                   completer_factory: Callable[[], Completer], retries: int = 1,
                   default: str = " ") -> DataFrame:
    """``(id, reply, status, attempts)`` for every input row; ids keep their type."""
    id_type = df.schema[id_col].dataType.simpleString()

    def answered(msgs: list, complete: Completer) -> tuple[list, list, list]:
        n = len(msgs)
        replies = [None] * n
        attempts = [0] * n
        status = ["failed"] * n
        todo = [k for k in range(n) if msgs[k] is not None]
        for attempt in range(retries + 1):
            if not todo:
                break
            if hasattr(complete, "attempt"):
                complete.attempt = attempt
            try:
                got = complete([msgs[k] for k in todo])
            except Exception:  # noqa: BLE001 - the whole call failed: every item failed once
                got = [None] * len(todo)
            nxt = []
            for k, r in zip(todo, got):
                attempts[k] += 1
                if isinstance(r, str):
                    replies[k], status[k] = r, "ok"
                else:
                    nxt.append(k)
            todo = nxt
        return [r if r is not None else default for r in replies], status, attempts

    def run(batches):
        complete = completer_factory()
        for batch in batches:
            # only the messages of one call are Python objects at a time
            for lo in range(0, batch.num_rows, CALL_ROWS):
                own = batch.slice(lo, CALL_ROWS)
                reply, status, attempts = answered([_to_messages(m) for m in own.column(1).to_pylist()], complete)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), pa.array(reply, pa.string()), pa.array(status, pa.string()), pa.array(attempts, pa.int32())],
                    ["id", "reply", "status", "attempts"])
    return df.select(id_col, messages_col).mapInArrow(
        run, f"id {id_type}, reply string, status string, attempts int")


def extract_chain(df: DataFrame, *, id_col: str, text_col: str, completer_factory: Callable[[], Completer],
                  questions: list[str] | None = None, retries: int = 1) -> DataFrame:
    """Chained extraction: the chain prompt asks question 1; each reply joins
    the transcript before the next question. Each round is one map stage whose
    result is checkpointed. Returns ``(id, messages, reply, status)`` after the
    last question."""
    qs = questions or P.CHAIN_QUESTIONS
    state = df.select(F.col(id_col).alias("id"),
                      P.build_prompt(F.col(text_col), "chain").alias("messages"))
    if questions is not None:
        state = state.select("id", F.concat(F.slice("messages", 1, 2),
                                            F.array(P.message("user", qs[0]))).alias("messages"))
    out = None
    for k in range(len(qs)):
        res = batch_complete(state, id_col="id", completer_factory=completer_factory, retries=retries)
        out = cut_lineage(state.join(res, "id"))
        if k + 1 < len(qs):
            state = out.select("id", P.append_turn(P.append_turn(F.col("messages"), "assistant", F.col("reply")),
                                                   "user", qs[k + 1]).alias("messages"))
    return out.select("id", "messages", "reply", "status")


def refine_replies(replies: DataFrame, *, completer_factory: Callable[[], Completer], style: str = "refine_one_shot",
                   retries: int = 1) -> DataFrame:
    """A second pass over the replies ``(id, reply, ...)`` of an extraction:
    ``(id, first_reply, reply, status, attempts)``."""
    first = cut_lineage(replies.select("id", F.col("reply").alias("first_reply")))
    asked = first.select("id", P.build_prompt(F.col("first_reply"), style).alias("messages"))
    return first.join(batch_complete(asked, id_col="id", completer_factory=completer_factory, retries=retries), "id")


class EchoCompleter:
    """Deterministic local stand-in for a hosted model (tests and examples):
    answers with a triple made of the first three words of the last user
    message, or 'error' when it has fewer than three.

    With ``fail_every`` = k, failures follow from the message alone, never from
    the order of calls: with h = first 32 bits of the message's md5, h % k == 0
    fails on the first attempt and h % k == 1 on every attempt."""

    def __init__(self, fail_every: int = 0):
        self.fail_every = fail_every
        self.attempt = 0

    def __call__(self, batch: list[list[dict]]) -> list:
        out = []
        for msgs in batch:
            last = next((m["content"] for m in reversed(msgs) if m["role"] == "user"), None) or ""
            if self.fail_every:
                h = int(hashlib.md5(last.encode()).hexdigest()[:8], 16) % self.fail_every
                if h == 1 or h == 0 and self.attempt == 0:
                    out.append(None)
                    continue
            words = last.split()
            out.append("error" if len(words) < 3 else f"<{words[0]}，{words[1]}，{words[2]}>")
        return out


def echo_completer_factory(fail_every: int = 0) -> Callable[[], Completer]:
    return lambda: EchoCompleter(fail_every)
