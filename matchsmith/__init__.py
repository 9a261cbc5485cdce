"""matchsmith: product record matching on Spark DataFrames.

Cleaning offer text, building labelled match / non-match pairs from clustered offers, label
noise, splits and folds, pair features, Spark ML matchers and their scores. Every step takes
and returns DataFrames; the heavy work is Spark joins, aggregations and windows.
"""

from matchsmith.session import ensure_checkpoint_dir, get_spark, read_table

__all__ = ["ensure_checkpoint_dir", "get_spark", "read_table"]
