"""Versicle: a Spark-native analytics engine for line-structured text."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get the library's functions by value, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
