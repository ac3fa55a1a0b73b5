"""Operators for preparing training text; nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# the functions of this package travel to the executors with their tasks, which need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
