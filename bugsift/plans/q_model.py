"""Model-backed queries (rows-only): MLlib operators and batch completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts as P
from ..operators import supervised as S
from ..operators.complete import batch_complete, echo_completer_factory, extract_chain, refine_replies
from ..operators.split import stratified_split
from .catalog import query, r6, table


@query("text_classifier")
def q_text_classifier(spark, sf):
    """TF-IDF + multinomial logistic regression: language of each document;
    model chosen on the validation split, scores for every split."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    sp = stratified_split(d, id_col="doc_id", label_col="lang", seed="42")
    _, scores = S.train_text_classifier(sp, text_col="text", label_col="lang", reg_params=(0.0, 0.1))
    return scores.select("reg_param", "split", "n", r6("accuracy").alias("accuracy"))


@query("kmeans")
def q_kmeans(spark, sf):
    return S.kmeans(table(spark, sf, "embeddings"), id_col="vec_id", vec_col="embedding", k=7, seed=3)


_MINI = dict(k=7, batch_rows=200, rounds=4, seed=3)


def _minibatch_sql(k: int, batch_rows: int, rounds: int, seed: int) -> str:
    """The rounds of mini-batch k-means, one by one."""
    draw = lambda t: f"(id % 1000003 * 2654435761 + {(t * 7919 + seed) * 40503}) % 4294967296"
    ctes = ["e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
            "x AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM e)",
            "lim AS (SELECT least(4294967296, ceil(%d * 4294967296.0 / count(*)))::BIGINT AS m FROM e)" % batch_rows,
            f"f AS (SELECT id, row_number() OVER (ORDER BY {draw(0)}, id) - 1 AS label FROM e)",
            f"c0 AS (SELECT f.label, x.k, x.x AS c, 0.0::DOUBLE AS seen FROM f JOIN x USING (id) WHERE f.label < {k})"]
    near = lambda rows, c: (f"(SELECT id, label FROM (SELECT x.id, c.label, row_number() OVER (PARTITION BY x.id ORDER BY "  # noqa: E731
                            f"sum((x.x - c.c) * (x.x - c.c)), c.label) AS r FROM x JOIN {c} c USING (k) {rows} GROUP BY x.id, c.label) WHERE r = 1)")
    for t in range(1, rounds + 1):
        ctes.append(f"a{t} AS {near(f'WHERE {draw(t)} < (SELECT m FROM lim)', f'c{t - 1}')}")
        ctes.append(f"s{t} AS (SELECT a.label, x.k, sum(x.x) AS total, count(*) AS n FROM a{t} a JOIN x USING (id) GROUP BY ALL)")
        ctes.append(f"c{t} AS (SELECT c.label, c.k, CASE WHEN s.n IS NULL THEN c.c ELSE c.c + (s.total - s.n * c.c) / (c.seen + s.n) END AS c, "
                    f"c.seen + coalesce(s.n, 0) AS seen FROM c{t - 1} c LEFT JOIN s{t} s USING (label, k))")
    return f"WITH {', '.join(ctes)} SELECT id AS vec_id, label::INT AS label FROM {near('', f'c{rounds}')}"


@query("kmeans_minibatch", _minibatch_sql(**_MINI))
def q_kmeans_minibatch(spark, sf):
    from ..operators.minibatch import minibatch_kmeans
    labels, _ = minibatch_kmeans(table(spark, sf, "embeddings"), id_col="vec_id", vec_col="embedding", **_MINI)
    return labels.select(F.col("id").alias("vec_id"), "label")


@query("segment_learned")
def q_segment_learned(spark, sf):
    """Every distinct run of letters of the documents, cut into units learned from all of them."""
    from ..operators.segmentation import learn_words, runs_of, segment_runs
    from ..session import cut_lineage
    runs = cut_lineage(runs_of(table(spark, sf, "documents").select(F.lower("text").alias("text")), "text", r"\p{L}+"))
    words = learn_words(runs, max_len=5)
    return segment_runs(runs, words, max_len=5).select("run", "n", F.array_join("words", "|").alias("units"))


def _text_vectors(spark, sf, k: int):
    from ..operators import features as feat
    from ..operators.encoder import encode_texts
    from ..operators.pairs import Vectors
    from .presets import PRESETS
    from .q_pairs import CLEAN
    f = feat.fit_transform(table(spark, sf, "documents"), PRESETS["base"].vectorizer, **CLEAN)
    return encode_texts(Vectors.sparse(f), k)


@query("text_embedding_scores")
def q_text_embedding_scores(spark, sf):
    """An embedding run from texts alone: vectors of the documents by truncated SVD of
    the base preset's rows, DBSCAN of dbscan_sb, scored against the language."""
    from ..operators import metrics as M
    from ..operators.dbscan import dbscan
    from ..operators.pairs import Vectors
    from ..session import cut_lineage
    from .presets import PRESETS
    vec = cut_lineage(_text_vectors(spark, sf, 16))
    lab = dbscan(Vectors.dense(vec, "id", "vec"), **PRESETS["dbscan_sb"].clusterers["dbscan"])
    long = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang").join(lab, "id").select(
        F.lit("dbscan_sb").alias("method"), F.col("lang").alias("y_true"), F.col("label").cast("string").alias("y_pred"))
    return M.scores(long).select("method", *[r6(m).alias(m) for m in ("purity", "ami", "v_measure")])


@query("silhouette", """WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  x AS (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM e),
  n AS (SELECT id, label, sum(x * x) AS sq FROM x GROUP BY ALL),
  c AS (SELECT n.label, count(*) AS m, sum(sq) AS sq FROM n GROUP BY n.label),
  y AS (SELECT label, k, sum(x) AS y FROM x GROUP BY ALL),
  -- sum of squared distances of a point to a cluster: m*|p|^2 + sum|q|^2 - 2 p.sum(q)
  d AS (SELECT x.id, x.label, y.label AS other, sum(x.x * y.y) AS dot FROM x JOIN y USING (k) GROUP BY ALL),
  t AS (SELECT d.id, d.label, d.other, c.m, c.m * n.sq + c.sq - 2 * d.dot AS total
        FROM d JOIN n ON n.id = d.id JOIN c ON c.label = d.other),
  a AS (SELECT id, total / (m - 1) AS a, m FROM t WHERE label = other),
  b AS (SELECT id, min(total / m) AS b FROM t WHERE label <> other GROUP BY id)
SELECT 'given_labels' AS method, round(avg(CASE WHEN m = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
FROM a JOIN b USING (id)""")
def q_silhouette(spark, sf):
    value = S.silhouette(table(spark, sf, "embeddings"), vec_col="embedding")
    return spark.createDataFrame([("given_labels", float(round(value, 6)))], "method string, silhouette double")


@query("lda_topics")
def q_lda_topics(spark, sf):
    return S.lda_topics(table(spark, sf, "documents"), id_col="doc_id", text_col="text", k=10, seed=3)


@query("word2vec_docs")
def q_word2vec_docs(spark, sf):
    v = S.word2vec_docs(table(spark, sf, "documents"), id_col="doc_id", text_col="text", size=50)
    return v.select("doc_id", F.size("vec").alias("dim"),
                    F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


@query("cbow_docs")
def q_cbow_docs(spark, sf):
    """Mean CBOW vector of every document, trained on all of them."""
    from ..operators.cbow import text_vectors, train
    d = table(spark, sf, "documents")
    model = train(d, id_col="doc_id", text_col="text", size=20, rounds=3, batch_rows=20_000)
    v = text_vectors(d, model, id_col="doc_id", text_col="text")
    return v.select(F.col("id").alias("doc_id"), F.size("vec").alias("dim"),
                    F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


_WORDS = "list_filter(regexp_split_to_array(m, '\\s+'), lambda x: x <> '')"
_SAID = "'<' || w[1] || '，' || w[2] || '，' || w[3] || '>'"


_COMPLETE = f"""WITH d AS (SELECT doc_id AS id, '{P.TEMPLATES.instruction.replace("'", "''")}' || text AS m FROM documents),
  h AS (SELECT id, {_WORDS} AS w, ('0x' || substr(md5(m), 1, 8))::BIGINT % 7 AS h FROM d)
SELECT id, CASE WHEN h = 1 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN h <= 1 THEN 2 ELSE 1 END::INT AS attempts,
  CASE WHEN h = 1 THEN ' ' ELSE {_SAID} END AS reply FROM h"""


@query("batch_complete", _COMPLETE)
def q_batch_complete(spark, sf):
    """Prefix one-shot prompts over every report, answered by the local stand-in
    completer (failures and retries follow from each message)."""
    d = table(spark, sf, "documents").select("doc_id", P.build_prompt(F.col("text"), "prefix_one_shot").alias("messages"))
    res = batch_complete(d, id_col="doc_id", completer_factory=echo_completer_factory(7), retries=1)
    return res.select("id", "status", "attempts", "reply")


@query("stream_complete", _COMPLETE)
def q_stream_complete(spark, sf):
    """The same answers from a stateful stream: retries come from the attempt log."""
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..streaming.requests import complete_stream
    folder = f"{ensure_checkpoint_dir(spark)}/requests-{uuid.uuid4().hex}"
    schema = table(spark, sf, "documents").schema

    def reports():
        return spark.readStream.schema(schema).parquet(f"{sf}/documents.parquet*").select(
            F.col("doc_id").alias("id"), "text")
    done = complete_stream(reports, log=f"{folder}/log", checkpoint=f"{folder}/checkpoint",
                           completer_factory=echo_completer_factory(7), retries=1)
    return done.select("id", "status", "attempts", "reply")


@query("refine_replies", f"""WITH d AS (SELECT doc_id AS id, '{P.TEMPLATES.instruction.replace("'", "''")}' || text AS m FROM documents),
  f AS (SELECT id, {_WORDS} AS w FROM d),
  r AS (SELECT id, {_SAID} AS first_reply, '{P.TEMPLATES.refine.replace("'", "''")}' || {_SAID} AS m FROM f),
  g AS (SELECT id, first_reply, {_WORDS} AS w FROM r)
SELECT id, first_reply, {_SAID} AS refined, 'ok' AS status FROM g""")
def q_refine_replies(spark, sf):
    """Second pass: the first pass's replies, refined one by one."""
    d = table(spark, sf, "documents").select("doc_id", P.build_prompt(F.col("text"), "prefix_zero_shot").alias("messages"))
    first = batch_complete(d, id_col="doc_id", completer_factory=echo_completer_factory(0))
    again = refine_replies(first, completer_factory=echo_completer_factory(0))
    return again.select("id", "first_reply", F.col("reply").alias("refined"), "status")


_Q = [q.replace("'", "''") for q in P.TEMPLATES.chain_questions]
_Q_REPLY = ["'<' || '" + "，".join(q.split()[:3]) + "' || '>'" for q in _Q]


@query("extract_chain", f"""SELECT doc_id AS id, 9 AS n_messages, {_Q_REPLY[3]} AS reply, 'ok' AS status,
  '{P.TEMPLATES.chain_context.replace("'", "''")}{P.TEMPLATES.screenshot_label}' || coalesce(regexp_extract(p.html, '<title>([^<]*)</title>', 1), '')
  || '{P.TEMPLATES.report_label}' || d.text || chr(10) || '{P.TEMPLATES.chain_ack}' || chr(10) || '{_Q[0]}' || chr(10) || {_Q_REPLY[0]}
  || chr(10) || '{_Q[1]}' || chr(10) || {_Q_REPLY[1]} || chr(10) || '{_Q[2]}' || chr(10) || {_Q_REPLY[2]} || chr(10) || '{_Q[3]}' AS transcript
FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id""")
def q_extract_chain(spark, sf):
    """Four-round chained extraction over screenshot text + report."""
    docs = table(spark, sf, "documents")
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"),
                                             F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("img"))
    fused = docs.join(pages, "doc_id", "left").select(
        "doc_id", P.fuse_text(F.col("text"), F.col("img"), "labelled").alias("fused"))
    out = extract_chain(fused, id_col="doc_id", text_col="fused", completer_factory=echo_completer_factory(0))
    return out.select("id", F.size("messages").alias("n_messages"), "reply", "status",
                      F.array_join(F.transform("messages", lambda m: m["content"]), "\n").alias("transcript"))
