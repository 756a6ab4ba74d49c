"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions of this subpackage travel to the executors by value: they need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
