"""A PySpark-native analytics engine for multi-stream vector and text data."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so no machine needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
