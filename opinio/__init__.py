"""opinio: product-review analytics as lazy Spark DataFrame operators.

Every public operator takes and returns DataFrames (or Columns) and runs
over all products at once; nothing is collected to the driver.
"""

from opinio.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
