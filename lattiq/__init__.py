"""Spark-native transcript, decoding-graph and training-data analytics."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value: it need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
