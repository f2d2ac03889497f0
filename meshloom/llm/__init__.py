"""Operators of a training-data pipeline; nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel whole, so executors needn't have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
