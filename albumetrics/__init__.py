"""Spark-native analytics for large media-region libraries.

Photos, persons and face regions are plain DataFrames; every read, edit and
clustering step is a function from DataFrames to DataFrames.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Batch functions defined in this package travel to the executors by value, so
# a cluster needs no installed copy of it.
register_pickle_by_value(sys.modules[__name__])
