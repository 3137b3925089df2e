"""agora — Spark-native operators for embedding and topic analytics.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from the
DataFrame/SQL API so Catalyst plans it; Python (Arrow batches) only runs
where a per-group numeric step or a user model is needed.
"""

from agora.session import checkpoint_dir, get_spark, write_shared

__all__ = ["get_spark", "checkpoint_dir", "write_shared"]
