"""Vote and vector queries on the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.dbscan import dbscan_from_edges
from ..operators.ensemble import stack_labels, vote_mean_onehot, vote_plurality
from ..operators.pairs import Vectors, links_each
from ..operators.vectors import norms, standardize_long
from ..session import cut_lineage
from .catalog import query, r6, table
from .q_pairs import EMB_SQL

EPS = [1.05, 1.1, 1.15]


def _labels_sql() -> str:
    """``est(id, estimator, label)``: DBSCAN(eps, 2) for each eps, canonical numbering."""
    ctes = [EMB_SQL]
    selects = []
    for k, eps in enumerate(EPS):
        p = f"e{k}_"
        ctes.append(f"""{p}pairs AS (SELECT i, j FROM ed WHERE dist <= {eps}),
    {p}und AS (SELECT i, j FROM {p}pairs UNION ALL SELECT j, i FROM {p}pairs),
    {p}deg AS (SELECT i AS id, count(*) + 1 AS d FROM {p}und GROUP BY i),
    {p}core AS (SELECT id FROM {p}deg WHERE d >= 2),
    {p}walk(id, comp) AS (SELECT id, id FROM {p}core
                          UNION SELECT u.j, w.comp FROM {p}walk w JOIN {p}und u ON u.i = w.id),
    {p}cc AS (SELECT id, min(comp) AS component FROM {p}walk GROUP BY id),
    {p}lab AS (SELECT id, (dense_rank() OVER (ORDER BY component) - 1)::INT AS label FROM {p}cc)""")
        selects.append(f"""SELECT n.vec_id AS id, '{eps}' AS estimator, coalesce(l.label, -1) AS label
        FROM embeddings n LEFT JOIN {p}lab l ON l.id = n.vec_id""")
    return ",\n    ".join(ctes) + ",\n    est AS (" + " UNION ALL ".join(selects) + ")"


def _labels(spark, sf):
    v = Vectors.dense(table(spark, sf, "embeddings"), "vec_id", "embedding")
    # one meeting of the cells for all eps; with 2 samples clusters are components, so links will do for pairs
    edges = cut_lineage(links_each(v, EPS))
    return stack_labels({str(e): dbscan_from_edges(v.with_ids(), edges.where(F.col("level") == k), 2)
                         for k, e in enumerate(EPS)})


@query("vote_plurality", f"""WITH RECURSIVE {_labels_sql()},
  c AS (SELECT id, label, count(*) AS c FROM est GROUP BY ALL),
  r AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY c DESC, label) AS rn FROM c)
SELECT id, label::INT AS label FROM r WHERE rn = 1""")
def q_vote_plurality(spark, sf):
    return vote_plurality(_labels(spark, sf))


@query("vote_mean_onehot", f"""WITH RECURSIVE {_labels_sql()},
  slots AS (SELECT estimator, label, dense_rank() OVER (PARTITION BY estimator ORDER BY label) - 1 AS slot
            FROM (SELECT DISTINCT estimator, label FROM est)),
  sc AS (SELECT e.id, s.slot, count(*) / 3.0 AS p FROM est e JOIN slots s USING (estimator, label)
         WHERE e.label <> -1 GROUP BY ALL),
  best AS (SELECT id, slot FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, slot) AS rn FROM sc)
           WHERE rn = 1)
SELECT e.vec_id AS id, coalesce(b.slot, 0)::INT AS label FROM embeddings e LEFT JOIN best b ON b.id = e.vec_id""")
def q_vote_mean_onehot(spark, sf):
    return vote_mean_onehot(_labels(spark, sf))


@query("embedding_norms", """SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm
FROM embeddings""")
def q_embedding_norms(spark, sf):
    return norms(table(spark, sf, "embeddings"), "vec_id", "embedding").select("vec_id", r6("norm").alias("norm"))


@query("standardize", """WITH ex AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x,
                              generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
  st AS (SELECT dim, avg(x) AS mean, stddev_pop(x) AS std FROM ex GROUP BY dim)
SELECT vec_id, dim::INT AS dim, round((x - mean) / CASE WHEN std = 0 THEN 1.0 ELSE std END, 6) AS z
FROM ex JOIN st USING (dim)""")
def q_standardize(spark, sf):
    z = standardize_long(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return z.select("vec_id", F.col("dim").cast("int").alias("dim"), r6("z").alias("z"))
