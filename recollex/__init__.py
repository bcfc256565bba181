"""recollex: agent-memory analytics expressed as Spark DataFrame plans."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions shipped to Python workers travel by value, so executors need no
# installation of this package and no particular working directory.
register_pickle_by_value(sys.modules[__name__])

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
