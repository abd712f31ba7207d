"""DuckDB SQL fragments for the oracle side of the catalogue.

The oracle is an independent, brute-force restatement of each query in plain
SQL; these helpers only keep the repeated CTEs (tokens, vocabulary, weights)
in one place.
"""

from __future__ import annotations

from ..operators.features import VectorizerConfig

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


def ngram_list(col: str, lo: int, hi: int) -> str:
    parts = []
    for k in range(lo, hi + 1):
        if k == 1:
            parts.append(col)
        else:
            parts.append(f"list_transform(range(1, len({col}) - {k} + 2), "
                         f"lambda i: array_to_string({col}[i:i + {k - 1}], ' '))")
    return parts[0] if len(parts) == 1 else "flatten([" + ", ".join(parts) + "])"


def vectorizer_ctes(cfg: VectorizerConfig, table: str = "documents", id_col: str = "doc_id",
                    tokens_expr: str = TOKENS) -> str:
    """CTEs ``tc(doc, term, tf)``, ``nd(n)``, ``vix(term, df, ctf, idf, term_idx)``,
    ``wts(doc, term, term_idx, w)`` (documents without terms absent)."""
    lo, hi = cfg.ngram_range
    terms = ngram_list("t", lo, hi)
    min_df = cfg.min_df if isinstance(cfg.min_df, int) else f"{cfg.min_df} * nd.n"
    max_df = f"{cfg.max_df} * nd.n" if isinstance(cfg.max_df, float) else cfg.max_df
    limit = f"ORDER BY ctf DESC, term LIMIT {cfg.max_features}" if cfg.max_features else ""
    if cfg.use_idf:
        s = 1 if cfg.smooth_idf else 0
        idf = f"ln((nd.n + {s}) / (df + {s})) + 1"
    else:
        idf = "1.0"
    tf = "1.0" if cfg.binary else ("1 + ln(tc.tf)" if cfg.sublinear_tf else "tc.tf * 1.0")
    norm = "w / sqrt(sum(w * w) OVER (PARTITION BY doc))" if cfg.norm == "l2" else "w"
    return f"""
    toks AS (SELECT {id_col} AS doc, {tokens_expr} AS t FROM {table}),
    grams AS (SELECT doc, unnest({terms}) AS term FROM toks),
    tc AS (SELECT doc, term, count(*) AS tf FROM grams GROUP BY doc, term),
    nd AS (SELECT count(*) AS n FROM {table}),
    st AS (SELECT term, count(*) AS df, sum(tf) AS ctf FROM tc GROUP BY term),
    voc AS (SELECT term, df, ctf, {idf} AS idf FROM st, nd
            WHERE df >= {min_df} AND df <= {max_df} {limit}),
    vix AS (SELECT *, row_number() OVER (ORDER BY term) - 1 AS term_idx FROM voc),
    raw AS (SELECT tc.doc, tc.term, vix.term_idx, ({tf}) * vix.idf AS w FROM tc JOIN vix USING (term)),
    wts AS (SELECT doc, term, term_idx, {norm} AS w FROM raw)"""
