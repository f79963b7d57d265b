"""quarry: tabular analytics and modelling as Spark jobs.

Operators are fit/apply pairs over Spark DataFrames: fitting is a few
distributed aggregations whose small result reaches the driver; applying
is a lazy column expression.
"""

from .session import get_spark, ensure_checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
