"""tablight: automated table analytics as Spark DataFrame operators.

Every public operator takes DataFrames (plus plain parameters) and returns a
DataFrame; the heavy work runs as Spark jobs (aggregations, joins, windows).
"""

from tablight.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
