"""Breakwater: change-point analytics on Spark."""

import sys

from pyspark import cloudpickle

# Executors get the library's functions by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
