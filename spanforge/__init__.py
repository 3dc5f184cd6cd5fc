"""Spark-first structural query engine: rules, patterns, graphs, cards and patches as DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so that workers
# need no copy of the repository on their own import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
