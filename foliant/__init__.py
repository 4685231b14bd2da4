"""Foliant: a PySpark-native engine from page text to clean knowledge records."""

import sys

from pyspark import cloudpickle

# Python workers may not see this package on their path: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
