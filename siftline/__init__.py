"""Rule-driven content scanning on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the query, so executors need
# pyarrow, pandas and numpy but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
