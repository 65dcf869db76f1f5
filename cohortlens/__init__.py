"""cohortlens: product-analytics operators on Spark DataFrames.

Every public operator is a pure function ``(DataFrame..., params) -> DataFrame``.
Heavy work stays in distributed aggregates, joins and windows; nothing is
collected to the driver inside an operator.
"""

from cohortlens.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
