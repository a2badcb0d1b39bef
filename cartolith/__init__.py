"""Spark-native linewise geospatial analytics."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: a cluster need not have it installed on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
