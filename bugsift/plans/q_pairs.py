"""Pair, graph and DBSCAN queries (embeddings and document TF rows)."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators.dbscan import cluster_sizes, dbscan
from ..operators.graph import connected_components, minimum_spanning_forest
from ..operators.pairs import (Vectors, epsilon_join, kth_neighbor_distance, pairwise_cosine,
                               similarity_blocks, similarity_matrix)
from .catalog import query, r6, table
from .presets import PRESETS, TEST
from .q_text import STOPWORDS, _STOP_SQL
from .sqlgen import TOKENS, vectorizer_ctes

EMB_SQL = """emb AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    ed AS (SELECT a.id AS i, b.id AS j,
                  sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS dist,
                  list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2]))
                    / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x)))) AS sim
           FROM emb a JOIN emb b ON a.id < b.id)"""


# preprocessing of the end-to-end runs: segments of the lower-cased text, less stop words
CLEAN = {"method": "cjk_bigrams", "stopwords": STOPWORDS}
CLEAN_TOKENS = f"list_filter({TOKENS}, lambda x: NOT list_contains({_STOP_SQL}, x))"


def doc_pairs_sql(eps: float, cfg=TEST, tokens: str = TOKENS) -> str:
    """CTEs ``pairs(i, j, dist)`` for the document eps-graph under a preset
    (TEST by default): term join for unit rows, plus the zero rows linked to
    each other."""
    return f"""{vectorizer_ctes(cfg, tokens_expr=tokens)},
    dots AS (SELECT a.doc AS i, b.doc AS j, sum(a.w * b.w) AS dot
             FROM wts a JOIN wts b ON a.term = b.term AND a.doc < b.doc GROUP BY a.doc, b.doc),
    zr AS (SELECT doc_id AS doc FROM documents WHERE doc_id NOT IN (SELECT doc FROM wts)),
    pairs AS (SELECT i, j, sqrt(greatest(2 - 2 * dot, 0)) AS dist FROM dots WHERE 2 - 2 * dot <= {eps * eps}
              UNION ALL SELECT a.doc, b.doc, 0.0 FROM zr a JOIN zr b ON a.doc < b.doc),
    nodes AS (SELECT doc_id AS id FROM documents)"""


def emb_pairs_sql(eps: float) -> str:
    return f"""{EMB_SQL},
    pairs AS (SELECT i, j, dist FROM ed WHERE dist <= {eps}),
    nodes AS (SELECT vec_id AS id FROM embeddings)"""


def components_sql(edges: str = "pairs", nodes: str = "nodes") -> str:
    """Recursive CTE ``cc(id, component)`` (component = smallest id reachable)."""
    return f"""und AS (SELECT i, j FROM {edges} UNION ALL SELECT j, i FROM {edges}),
    walk(id, comp) AS (SELECT id, id FROM {nodes}
                       UNION SELECT u.j, w.comp FROM walk w JOIN und u ON u.i = w.id),
    cc AS (SELECT id, min(comp) AS component FROM walk GROUP BY id)"""


def dbscan_sql(min_samples: int) -> str:
    """CTE ``lab(id, label)`` from ``pairs`` / ``nodes``: core = degree+1 >= m."""
    return f"""deg AS (SELECT n.id, 1 + count(u.j) AS d FROM nodes n LEFT JOIN
                   (SELECT i, j FROM pairs UNION ALL SELECT j, i FROM pairs) u ON u.i = n.id GROUP BY n.id),
    core AS (SELECT id FROM deg WHERE d >= {min_samples}),
    cpairs AS (SELECT i, j FROM pairs WHERE i IN (SELECT id FROM core) AND j IN (SELECT id FROM core)),
    {components_sql("cpairs", "core")},
    bord AS (SELECT u.i AS id, min(cc.component) AS component
             FROM (SELECT i, j FROM pairs UNION ALL SELECT j, i FROM pairs) u
             JOIN cc ON cc.id = u.j WHERE u.i NOT IN (SELECT id FROM core) GROUP BY u.i),
    roots AS (SELECT * FROM cc UNION ALL SELECT * FROM bord),
    lab AS (SELECT n.id, coalesce(dense_rank() OVER (ORDER BY r.component) - 1, -1) AS label0, r.component
            FROM nodes n LEFT JOIN roots r ON r.id = n.id),
    labf AS (SELECT id, CASE WHEN component IS NULL THEN -1 ELSE label0 END::INT AS label FROM lab)"""


def _emb(spark, sf):
    return Vectors.dense(table(spark, sf, "embeddings"), "vec_id", "embedding")


def _docs(spark, sf):
    return Vectors.sparse(feat.fit_transform(table(spark, sf, "documents"), TEST))


@query("pairwise_cosine", f"""WITH {EMB_SQL}
SELECT i, j, round(sim, 6) AS sim FROM ed""")
def q_pairwise_cosine(spark, sf):
    return pairwise_cosine(_emb(spark, sf)).select("i", "j", r6("sim").alias("sim"))


@query("similarity_matrix", f"""WITH {EMB_SQL}
SELECT i, j, round(sim, 6) AS sim FROM ed UNION ALL SELECT j, i, round(sim, 6) FROM ed
UNION ALL SELECT vec_id, vec_id, 1.0 FROM embeddings""")
def q_similarity_matrix(spark, sf):
    v = _emb(spark, sf)
    m = similarity_matrix(pairwise_cosine(v), v.with_ids())
    return m.select("i", "j", r6("sim").alias("sim"))


@query("similarity_blocks", f"""WITH {EMB_SQL}, p AS (SELECT i, j, sim FROM ed WHERE sim >= 0.25),
o AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS p FROM embeddings),
m AS (SELECT i, j, sim FROM p UNION ALL SELECT j, i, sim FROM p UNION ALL SELECT vec_id, vec_id, 1.0 FROM embeddings)
SELECT m.i AS row_id, a.p AS row, (b.p // 64)::BIGINT AS block, count(*) AS n_values, round(sum(m.sim), 6) AS total,
  max(b.p % 64)::BIGINT AS last_column
FROM m JOIN o a ON a.id = m.i JOIN o b ON b.id = m.j GROUP BY ALL""")
def q_similarity_blocks(spark, sf):
    """The full matrix as block rows, written by column block and read back."""
    from ..session import cut_lineage, ensure_checkpoint_dir
    import uuid
    v = _emb(spark, sf)
    folder = f"{ensure_checkpoint_dir(spark)}/matrix-{uuid.uuid4().hex}"
    similarity_blocks(cut_lineage(pairwise_cosine(v, 0.25)), v.with_ids(), 64).write.partitionBy("block").parquet(folder)
    m = spark.read.parquet(folder)
    filled = F.array_remove("vals", 0.0)
    # the last value that is not 0 is the first one like it from the end
    last = F.size("vals") - F.array_position(F.reverse("vals"), F.try_element_at(filled, F.lit(-1)))
    return m.select("row_id", "row", F.col("block").cast("long").alias("block"), F.size(filled).cast("long").alias("n_values"),
                    r6(F.aggregate(filled, F.lit(0.0), lambda a, x: a + x)).alias("total"),
                    last.cast("long").alias("last_column"))


@query("epsilon_pairs_dense", f"""WITH {EMB_SQL}
SELECT i, j, round(dist, 6) AS dist FROM ed WHERE dist <= 1.2""")
def q_epsilon_pairs_dense(spark, sf):
    return epsilon_join(_emb(spark, sf), 1.2).select("i", "j", r6("dist").alias("dist"))


@query("epsilon_pairs_sparse", f"""WITH {doc_pairs_sql(0.71)}
SELECT i, j, round(dist, 6) AS dist FROM pairs""")
def q_epsilon_pairs_sparse(spark, sf):
    return epsilon_join(_docs(spark, sf), 0.71).select("i", "j", r6("dist").alias("dist"))


@query("epsilon_pairs_close", f"""WITH {doc_pairs_sql(0.3)}
SELECT i, j, round(dist, 6) AS dist FROM pairs""")
def q_epsilon_pairs_close(spark, sf):
    """A selective distance: near-equal reports only."""
    return epsilon_join(_docs(spark, sf), 0.3).select("i", "j", r6("dist").alias("dist"))


@query("epsilon_pairs_index", f"""WITH {doc_pairs_sql(0.71)}
SELECT i, j, round(dist, 6) AS dist FROM pairs""")
def q_epsilon_pairs_index(spark, sf):
    """Same answer as epsilon_pairs_sparse through the inverted-index path
    (prefix filtering), the method chosen automatically at large n."""
    return epsilon_join(_docs(spark, sf), 0.71, method="index").select("i", "j", r6("dist").alias("dist"))


@query("core_distance", f"""WITH {EMB_SQL},
und AS (SELECT i AS id, j AS other, dist FROM ed UNION ALL SELECT j, i, dist FROM ed),
r AS (SELECT id, dist, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS rn FROM und)
SELECT id, round(dist, 6) AS core_dist FROM r WHERE rn = 4""")
def q_core_distance(spark, sf):
    return kth_neighbor_distance(_emb(spark, sf), 5).select("id", r6("core_dist").alias("core_dist"))


@query("connected_components", f"""WITH RECURSIVE {emb_pairs_sql(1.1)}, {components_sql()}
SELECT id, component FROM cc""")
def q_connected_components(spark, sf):
    v = _emb(spark, sf)
    return connected_components(epsilon_join(v, 1.1), v.with_ids())


@query("dbscan_sparse", f"""WITH RECURSIVE {doc_pairs_sql(0.4)}, {dbscan_sql(2)}
SELECT id, label FROM labf""")
def q_dbscan_sparse(spark, sf):
    return dbscan(_docs(spark, sf), 0.4, 2)


@query("dbscan_dense", f"""WITH RECURSIVE {emb_pairs_sql(1.15)}, {dbscan_sql(1)}
SELECT id, label FROM labf""")
def q_dbscan_dense(spark, sf):
    return dbscan(_emb(spark, sf), 1.15, 1)


@query("dbscan_min5", f"""WITH RECURSIVE {emb_pairs_sql(1.2)}, {dbscan_sql(5)}
SELECT id, label FROM labf""")
def q_dbscan_min5(spark, sf):
    return dbscan(_emb(spark, sf), 1.2, 5)


# an edge is in the forest unless smaller edges (by distance, i, j) already join its ends
@query("minimum_spanning_forest", f"""WITH RECURSIVE {EMB_SQL},
  pairs AS (SELECT i, j, dist FROM ed WHERE dist <= 1.15),
  und AS (SELECT i AS a, j AS b, i, j, dist FROM pairs UNION ALL SELECT j, i, i, j, dist FROM pairs),
  walk(ei, ej, ed, node) AS (
    SELECT i, j, dist, i FROM pairs
    UNION SELECT w.ei, w.ej, w.ed, u.b FROM walk w JOIN und u ON u.a = w.node
      AND (u.dist < w.ed OR (u.dist = w.ed AND (u.i < w.ei OR (u.i = w.ei AND u.j < w.ej)))))
SELECT i, j, round(dist, 6) AS dist FROM pairs p
WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.ei = p.i AND w.ej = p.j AND w.node = p.j)""")
def q_minimum_spanning_forest(spark, sf):
    """Borůvka forest of the eps=1.15 embedding graph."""
    v = _emb(spark, sf)
    return minimum_spanning_forest(v, edges=epsilon_join(v, 1.15)).select("i", "j", r6("dist").alias("dist"))


@query("attach_labels", f"""WITH RECURSIVE {doc_pairs_sql(0.4)}, {dbscan_sql(2)}
SELECT d.doc_id, d.lang, l.label FROM documents d LEFT JOIN labf l ON l.id = d.doc_id""")
def q_attach_labels(spark, sf):
    docs = table(spark, sf, "documents")
    lab = dbscan(_docs(spark, sf), 0.4, 2).withColumnRenamed("id", "doc_id")
    return docs.select("doc_id", "lang").join(lab, "doc_id", "left")


@query("cluster_sizes", f"""WITH RECURSIVE {doc_pairs_sql(0.4)}, {dbscan_sql(2)}
SELECT label, count(*) AS n FROM labf GROUP BY label""")
def q_cluster_sizes(spark, sf):
    return cluster_sizes(dbscan(_docs(spark, sf), 0.4, 2))


@query("export_clusters", f"""WITH RECURSIVE {doc_pairs_sql(0.4)}, {dbscan_sql(2)}
SELECT l.label, CASE WHEN l.label = -1 THEN 'Noise:' ELSE 'Cluster ' || (l.label + 1) END AS name,
       d.doc_id, d.text
FROM labf l JOIN documents d ON d.doc_id = l.id""")
def q_export_clusters(spark, sf):
    from ..sources.export import export_clusters
    lab = dbscan(_docs(spark, sf), 0.4, 2).withColumnRenamed("id", "doc_id")
    return export_clusters(table(spark, sf, "documents"), lab, id_col="doc_id", text_col="text")


_DBSCAN_TI = PRESETS["dbscan_ti"]


def _scores_sql_dbscan_ti() -> str:
    from .q_metrics import scores_sql
    eps = _DBSCAN_TI.clusterers["dbscan"]["eps"]
    ms = _DBSCAN_TI.clusterers["dbscan"]["min_samples"]
    long = """long AS (SELECT 'dbscan_ti' AS method, d.lang AS t, CAST(l.label AS VARCHAR) AS p
                       FROM documents d JOIN labf l ON l.id = d.doc_id)"""
    return (f"WITH RECURSIVE {doc_pairs_sql(eps, _DBSCAN_TI.vectorizer, CLEAN_TOKENS)}, {dbscan_sql(ms)}, "
            + scores_sql(long))


@query("dbscan_ti_scores", _scores_sql_dbscan_ti() + """
SELECT method, round(purity, 6) AS purity, round(ami, 6) AS ami, round(v_measure, 6) AS v_measure FROM sc""")
def q_dbscan_ti_scores(spark, sf):
    """A dbscan_ti run end to end: segmentation, stop words, preset features
    (1-2-grams, max_df 0.7, min_df 12, top 5000, TF, L2), DBSCAN(0.71, 1), scored
    against the document language with purity, AMI and V-measure."""
    from ..operators import metrics as M
    docs = table(spark, sf, "documents")
    v = Vectors.sparse(feat.fit_transform(docs, _DBSCAN_TI.vectorizer, **CLEAN))
    lab = dbscan(v, **_DBSCAN_TI.clusterers["dbscan"]).withColumnRenamed("id", "doc_id")
    long = docs.select("doc_id", "lang").join(lab, "doc_id").select(
        F.lit("dbscan_ti").alias("method"), F.col("lang").alias("y_true"),
        F.col("label").cast("string").alias("y_pred"))
    return M.scores(long).select("method", *[r6(m).alias(m) for m in ("purity", "ami", "v_measure")])
