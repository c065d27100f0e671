"""Corpus-scale document preparation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are sent whole, so that executors do not need
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
