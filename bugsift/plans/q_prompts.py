"""Prompt, transcript and reply queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts as P
from ..operators import features as feat
from .catalog import query, table
from .presets import TEST
from .sqlgen import vectorizer_ctes


def s(x: str) -> str:
    """SQL string literal."""
    return "'" + x.replace("'", "''") + "'"


TITLE = "<title>([^<]*)</title>"
T = P.TEMPLATES


def _reply_col():
    """Stand-in replies derived from each document (8 shapes by id)."""
    k = F.pmod(F.col("doc_id"), F.lit(8))
    n = F.col("n_chars").cast("string")
    return (F.when(k == 0, F.concat(F.lit("<"), F.col("lang"), F.lit("，"), F.col("source"), F.lit("，"), n, F.lit(">")))
            .when(k == 3, F.concat(F.lit("<"), F.col("lang"), F.lit(", "), F.col("source"), F.lit(";tap, hold;"), n,
                                   F.lit(", twice>")))
            .when(k == 4, F.concat(F.lit("Triple: <"), F.col("lang"), F.lit(";"), F.col("source"), F.lit(";"), n,
                                   F.lit("> done")))
            .when(k.isin(1, 5), F.lit("error"))
            .when(k.isin(2, 6), F.lit(" "))
            .otherwise(F.concat(F.lit("scene: "), F.col("lang"))))


REPLY_SQL = """CASE doc_id % 8 WHEN 0 THEN '<' || lang || '，' || source || '，' || n_chars || '>'
    WHEN 3 THEN '<' || lang || ', ' || source || ';tap, hold;' || n_chars || ', twice>'
    WHEN 4 THEN 'Triple: <' || lang || ';' || source || ';' || n_chars || '> done'
    WHEN 1 THEN 'error' WHEN 5 THEN 'error' WHEN 2 THEN ' ' WHEN 6 THEN ' '
    ELSE 'scene: ' || lang END"""


@query("fuse_text", f"""SELECT d.doc_id,
  {s(T.screenshot_label)} || coalesce(regexp_extract(p.html, '{TITLE}', 1), '') || {s(T.report_label)} || d.text AS fused
FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id""")
def q_fuse_text(spark, sf):
    docs = table(spark, sf, "documents")
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"),
                                             F.regexp_extract("html", TITLE, 1).alias("image_text"))
    return docs.join(pages, "doc_id", "left").select(
        "doc_id", P.fuse_text(F.col("text"), F.col("image_text"), "labelled").alias("fused"))


def _prompt_query(name, style, msgs, src_sql="documents", text="text", src_fn=None):
    sql = "\nUNION ALL ".join(
        f"SELECT doc_id, {pos}::INT AS pos, '{role}' AS role, {content} AS content FROM {src_sql}"
        for pos, (role, content) in enumerate(msgs))

    def q(spark, sf):
        src = src_fn(spark, sf) if src_fn else table(spark, sf, "documents")
        df = src.select("doc_id", P.build_prompt(F.col(text), style).alias("messages"))
        return P.flatten_messages(df, ["doc_id"])
    query(name, sql)(q)


_REPLIES = {"src_sql": f"(SELECT doc_id, {REPLY_SQL} AS reply FROM documents)", "text": "reply",
            "src_fn": lambda spark, sf: table(spark, sf, "documents").select("doc_id", _reply_col().alias("reply"))}
_ROLE_EXAMPLE = T.persona_example.format(report=T.example_report, triple=T.example_triple)

_prompt_query("prompt_prefix_zero_shot", "prefix_zero_shot", [("user", f"{s(T.instruction)} || text")])
_prompt_query("prompt_prefix_one_shot", "prefix_one_shot", [
    ("user", s(T.instruction + T.example_report)), ("assistant", s(T.example_triple)),
    ("user", f"{s(T.instruction)} || text")])
_prompt_query("prompt_suffix_zero_shot", "suffix_zero_shot", [("user", f"text || {s(T.suffix)}")])
_prompt_query("prompt_suffix_one_shot", "suffix_one_shot", [
    ("user", s(T.example_report + T.suffix)), ("assistant", s(T.example_triple)),
    ("user", f"text || {s(T.suffix)}")])
_prompt_query("prompt_role", "role_zero_shot", [
    ("user", s(T.persona)), ("assistant", s(T.persona_ack)), ("user", "text")])
_prompt_query("prompt_role_one_shot", "role_one_shot", [
    ("user", s(T.persona + _ROLE_EXAMPLE)), ("assistant", s(T.persona_ack)), ("user", "text")])
_prompt_query("prompt_sentence", "sentence", [
    ("user", s(T.sentence)), ("assistant", s(T.sentence_ack)), ("user", "text")])
_prompt_query("prompt_refine_zero_shot", "refine_zero_shot", [("user", f"{s(T.refine)} || reply")], **_REPLIES)
_prompt_query("prompt_refine", "refine_one_shot", [
    ("user", s(T.refine + T.refine_example)), ("assistant", s(T.refine_triple)),
    ("user", f"{s(T.refine)} || reply")], **_REPLIES)
_prompt_query("prompt_chain", "chain", [
    ("user", f"{s(T.chain_context)} || text"), ("assistant", s(T.chain_ack)), ("user", s(T.chain_questions[0]))])


@query("build_transcripts", """SELECT conv_id, count(*)::BIGINT AS n_messages,
       string_agg(role, ',' ORDER BY turn) AS roles, sum(length(text))::BIGINT AS n_chars
FROM conversations GROUP BY conv_id""")
def q_build_transcripts(spark, sf):
    t = P.build_transcripts(table(spark, sf, "conversations"))
    return t.select("conv_id", F.size("messages").cast("long").alias("n_messages"),
                    F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
                    F.aggregate("messages", F.lit(0).cast("long"),
                                lambda a, m: a + F.length(m["content"])).alias("n_chars"))


@query("append_turn", f"""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos,
       role, text AS content FROM conversations
UNION ALL SELECT conv_id, count(*)::INT, 'user', {s(T.chain_questions[3])} FROM conversations GROUP BY conv_id""")
def q_append_turn(spark, sf):
    t = P.build_transcripts(table(spark, sf, "conversations"))
    t = t.select("conv_id", P.append_turn(F.col("messages"), "user", T.chain_questions[3]).alias("messages"))
    return P.flatten_messages(t, ["conv_id"])


_PHRASES_SQL = "[" + ", ".join(s(p) for p in P.PHRASES) + "]"


@query("perturb_text", f"""SELECT doc_id, {_PHRASES_SQL}[(('0x' || substr(md5('7' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % {len(P.PHRASES)}) + 1] AS phrase,
       text || {_PHRASES_SQL}[(('0x' || substr(md5('7' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % {len(P.PHRASES)}) + 1] AS perturbed
FROM documents""")
def q_perturb_text(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", P.pick_phrase(F.col("doc_id"), "7").alias("phrase"),
                    P.perturb_text(F.col("text"), F.col("doc_id"), "7").alias("perturbed"))


# the triple's text is cut at one kind of separator, written without the operator's patterns
_PARSE_SQL = f"""WITH r AS (SELECT doc_id, {REPLY_SQL} AS r FROM documents),
  b AS (SELECT doc_id, r, contains(r, '<') AND contains(r, '>') AS has,
               replace(replace(string_split(string_split(r, '<')[2], '>')[1], '；', ';'), '，', ',') AS t FROM r),
  p AS (SELECT doc_id, r, has, CASE WHEN contains(t, ';') THEN string_split(t, ';') ELSE string_split(t, ',') END AS p FROM b),
  o AS (SELECT doc_id, r, p, has AND len(p) = 3 AS ok FROM p)
SELECT doc_id,
  CASE WHEN ok THEN 'ok' WHEN trim(r) = '' THEN 'blank'
       WHEN contains(lower(r), 'error') THEN 'error' ELSE 'malformed' END AS status,
  CASE WHEN ok THEN trim(p[1]) END AS scene,
  CASE WHEN ok THEN trim(p[2]) END AS operation,
  CASE WHEN ok THEN trim(p[3]) END AS defect
FROM o"""


def _parsed(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", _reply_col().alias("r"))
    return d.select("doc_id", P.parse_triple(F.col("r")).alias("t")).select("doc_id", "t.*")


@query("parse_triple", _PARSE_SQL)
def q_parse_triple(spark, sf):
    return _parsed(spark, sf)


@query("triple_status_counts", f"SELECT status, count(*) AS n FROM ({_PARSE_SQL}) GROUP BY status")
def q_triple_status_counts(spark, sf):
    return _parsed(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("length_histogram", "SELECT length(text)::BIGINT AS length, count(*) AS n FROM documents GROUP BY 1")
def q_length_histogram(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy(F.length("text").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))


@query("encode_fixed_length", f"""WITH {vectorizer_ctes(TEST)},
  ex AS (SELECT doc, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM toks),
  ids AS (SELECT ex.doc, pos // 50 AS chunk, list(coalesce(vix.term_idx + 2, 1) ORDER BY ex.pos) AS ids
          FROM ex LEFT JOIN vix USING (term) GROUP BY ex.doc, pos // 50),
  allc AS (SELECT doc, chunk, ids FROM ids
           UNION ALL SELECT doc, 0, [] FROM toks WHERE len(t) = 0)
SELECT doc AS doc_id, chunk::BIGINT AS chunk,
       array_to_string(list_concat(ids, list_transform(range(50 - len(ids)), lambda x: 0)), ' ') AS input_ids,
       len(ids)::INT AS n_real
FROM allc""")
def q_encode_fixed_length(spark, sf):
    """Whole texts as consecutive 50-token windows over the TEST vocabulary."""
    docs = table(spark, sf, "documents")
    f = feat.fit_transform(docs, TEST)
    # the tokens of the fit are dealt by id already: the chunks need no shuffle
    toks = f.tokens.withColumnRenamed("terms", "tokens")
    enc = P.encode_fixed_length(toks, f.vocab, id_col="doc_id", n=50, vocab_bound=TEST.max_features)
    return enc.select("doc_id", "chunk", F.array_join("input_ids", " ").alias("input_ids"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("int").alias("n_real"))

