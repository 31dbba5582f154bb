"""Spark-native analytics for keyed environmental time series."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
