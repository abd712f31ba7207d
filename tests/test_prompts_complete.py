from pyspark.sql import functions as F

from bugsift.functions import prompts as P
from bugsift.operators.complete import EchoCompleter, batch_complete, extract_chain


def test_parse_triple_cases(spark):
    replies = ["<a，b，c>", "<a;b;c>", "error", " ", "The triple is <x, y, z> ok", "<a，b>",
               "<home, top bar;tap;slow, twice>", "<a,b;c>", "<a, b, c, d>"]
    df = spark.createDataFrame(list(enumerate(replies)), "id long, r string")
    got = [r.t for r in df.orderBy("id").select(P.parse_triple(F.col("r")).alias("t")).collect()]
    assert [t.status for t in got] == ["ok", "ok", "error", "blank", "ok", "malformed", "ok", "malformed", "ok"]
    assert (got[0].scene, got[0].operation, got[0].defect) == ("a", "b", "c")
    assert (got[4].scene, got[4].operation, got[4].defect) == ("x", "y", "z")
    assert (got[6].scene, got[6].operation, got[6].defect) == ("home, top bar", "tap", "slow, twice")
    assert (got[8].scene, got[8].operation, got[8].defect) == ("a", "b", "c, d")


def test_prompt_styles_shape(spark):
    df = spark.createDataFrame([(1, "report text")], "id long, t string")
    for style, n in [("prefix_zero_shot", 1), ("prefix_one_shot", 3), ("suffix_one_shot", 3),
                     ("role_zero_shot", 3), ("sentence", 3), ("refine_one_shot", 3), ("chain", 3)]:
        msgs = df.select(P.build_prompt(F.col("t"), style).alias("m")).first().m
        assert len(msgs) == n
        assert msgs[-1].role == "user"
        assert "report text" in msgs[-1].content or style == "chain"
    fused = df.select(P.fuse_text(F.col("t"), F.lit("SCREEN"), "labelled").alias("f")).first().f
    assert fused == P.TEMPLATES.screenshot_label + "SCREEN" + P.TEMPLATES.report_label + "report text"


def test_transcripts_and_append(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", "c")],
                                  "conv_id long, turn long, role string, text string")
    t = P.build_transcripts(turns)
    t = t.select("conv_id", P.append_turn(F.col("messages"), "user", "next?").alias("messages"))
    flat = {(r.conv_id, r.pos): (r.role, r.content) for r in P.flatten_messages(t, ["conv_id"]).collect()}
    assert flat == {(1, 0): ("user", "a"), (1, 1): ("assistant", "b"), (1, 2): ("user", "next?"),
                    (2, 0): ("user", "c"), (2, 1): ("user", "next?")}


class Flaky:
    """Fails each item's first call; ``always`` fails forever; ``boom`` raises."""

    def __init__(self, mode):
        self.mode, self.seen = mode, set()

    def __call__(self, batch):
        if self.mode == "boom":
            raise RuntimeError("service down")
        out = []
        for msgs in batch:
            key = msgs[-1]["content"]
            if self.mode == "always" or key not in self.seen:
                self.seen.add(key)
                out.append(None)
            else:
                out.append("<s，o，d>")
        return out


def test_batch_complete_retries(spark):
    df = spark.createDataFrame([(i, f"r{i}") for i in range(20)], "id long, t string").select(
        "id", P.build_prompt(F.col("t"), "prefix_zero_shot").alias("messages"))
    once = {r.id: r for r in batch_complete(df, id_col="id", completer_factory=lambda: Flaky("once"),
                                            retries=1).collect()}
    assert len(once) == 20 and all(r.status == "ok" and r.attempts == 2 for r in once.values())
    always = batch_complete(df, id_col="id", completer_factory=lambda: Flaky("always"), retries=2).collect()
    assert all(r.reply == " " and r.status == "failed" and r.attempts == 3 for r in always)
    boom = batch_complete(df, id_col="id", completer_factory=lambda: Flaky("boom"), retries=1).collect()
    assert len(boom) == 20 and {r.status for r in boom} == {"failed"}


def test_stand_in_failures_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(f"id{i}", f"r{i % 40} x y") for i in range(80)] + [("null", None)], "id string, t string")
    msgs = df.select("id", F.when(F.col("t").isNotNull(), P.build_prompt(F.col("t"), "role_zero_shot")).alias("messages"))
    runs = [sorted(tuple(r) for r in batch_complete(msgs.repartition(k), id_col="id",
                                                    completer_factory=lambda: EchoCompleter(5)).collect()) for k in (1, 4, 7)]
    assert runs[0] == runs[1] == runs[2]
    assert {r[2:] for r in runs[0]} == {("ok", 1), ("ok", 2), ("failed", 2), ("failed", 0)}


def test_templates_are_parameters(spark):
    df = spark.createDataFrame([(1, "note")], "id long, t string")
    own = P.PromptTemplates(instruction="Say: ")
    assert df.select(P.build_prompt(F.col("t"), "prefix_zero_shot", own).alias("m")).first().m[0].content == "Say: note"


def test_extract_chain_four_rounds(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta")], "id long, t string")
    out = extract_chain(df, id_col="id", text_col="t", completer_factory=lambda: EchoCompleter()).first()
    # context, ack, q1, (a1, q2), (a2, q3), (a3, q4)
    assert len(out.messages) == 3 + 2 * 3
    assert out.messages[-1].content == P.CHAIN_QUESTIONS[3]
    assert out.status == "ok" and out.reply.startswith("<")


def test_perturb_is_deterministic(spark):
    df = spark.createDataFrame([(i, "x") for i in range(50)], "id long, t string")
    a = [r.p for r in df.orderBy("id").select(P.perturb_text(F.col("t"), F.col("id"), "s").alias("p")).collect()]
    b = [r.p for r in df.repartition(5).orderBy("id").select(
        P.perturb_text(F.col("t"), F.col("id"), "s").alias("p")).collect()]
    assert a == b and len(set(a)) > 5 and all(x.startswith("x") for x in a)


def test_encode_fixed_length_chunks_whole_text(spark):
    toks = spark.createDataFrame([(1, ["a", "b", "zz", "a", "b"]), (2, [])], "id long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "term string, term_idx int")
    out = {(r.id, r.chunk): (r.input_ids, r.attention_mask)
           for r in P.encode_fixed_length(toks, vocab, id_col="id", n=2, vocab_bound=2).collect()}
    assert out == {(1, 0): ([2, 3], [1, 1]), (1, 1): ([1, 2], [1, 1]), (1, 2): ([3, 0], [1, 0]),
                   (2, 0): ([0, 0], [0, 0])}
    trunc = P.encode_fixed_length(toks, vocab, id_col="id", n=2, overflow="truncate").collect()
    assert sorted((r.id, r.chunk, r.input_ids) for r in trunc) == [(1, 0, [2, 3]), (2, 0, [0, 0])]
