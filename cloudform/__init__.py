"""cloudform: a Spark-native engine for corpora and clouds of embedded documents."""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# Functions of this package travel to the executors by value, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
