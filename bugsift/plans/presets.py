"""Named vectoriser + clusterer settings.

The reference's runs are defined by these settings (fixed values, kept as the
reference states them); ``TEST`` is this repository's own small preset used by
the oracle-checked queries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..operators.features import VectorizerConfig


@dataclass(frozen=True)
class Preset:
    vectorizer: VectorizerConfig | None
    clusterers: dict = field(default_factory=dict)


# Fixed values: (n-gram range, max_df, min_df, max_features, weighting) and
# clusterer parameters per preset.
PRESETS: dict[str, Preset] = {
    "base": Preset(VectorizerConfig(ngram_range=(1, 4), max_df=0.5, min_df=2, sublinear_tf=True),
                   {"hdbscan": dict(min_cluster_size=2, min_samples=1),
                    "dbscan": dict(eps=0.03, min_samples=2), "ward": dict(threshold=2.0)}),
    "hc_ti": Preset(VectorizerConfig(ngram_range=(1, 2), max_df=0.9, min_df=16, max_features=5000, use_idf=False),
                    {"ward": dict(threshold=1.4)}),
    "dbscan_ti": Preset(VectorizerConfig(ngram_range=(1, 2), max_df=0.7, min_df=12, max_features=5000, use_idf=False),
                        {"dbscan": dict(eps=0.71, min_samples=1)}),
    "hdbscan_ti": Preset(VectorizerConfig(ngram_range=(1, 2), max_df=0.6, min_df=10, max_features=5000, use_idf=False),
                         {"hdbscan": dict(min_cluster_size=2, min_samples=1, eps=0.75)}),
    "change_ti": Preset(VectorizerConfig(ngram_range=(1, 2), max_df=0.9, min_df=9, max_features=5000, use_idf=False),
                        {"hdbscan": dict(min_cluster_size=2, min_samples=1, eps=0.75),
                         "dbscan": dict(eps=1.3, min_samples=1), "ward": dict(threshold=2.0)}),
    "output_ti": Preset(VectorizerConfig(ngram_range=(1, 2), max_df=0.411, min_df=9, max_features=5000, use_idf=False),
                        {"hdbscan": dict(min_cluster_size=11, min_samples=1, eps=0.85),
                         "dbscan": dict(eps=0.85, min_samples=2), "ward": dict(threshold=2.0)}),
    "hc_sb": Preset(None, {"ward": dict(threshold=1.4)}),
    "dbscan_sb": Preset(None, {"dbscan": dict(eps=0.71, min_samples=1)}),
    "hdbscan_sb": Preset(None, {"hdbscan": dict(min_cluster_size=2, min_samples=1, eps=0.71)}),
    "change_sb": Preset(None, {"hdbscan": dict(min_cluster_size=2, min_samples=1, eps=0.71),
                               "dbscan": dict(eps=1.3, min_samples=1), "ward": dict(threshold=2.0)}),
    "keywords_default": Preset(VectorizerConfig()),
    "hcluster": Preset(VectorizerConfig(), {"ward": dict(threshold=2.0)}),
}

# This repository's oracle-checked preset: 1-grams, min_df 9, max_df 0.9,
# top 500 terms, TF only, L2.
TEST = VectorizerConfig(ngram_range=(1, 1), min_df=9, max_df=0.9, max_features=500, use_idf=False)
