"""placelake: a PySpark-native engine for place data."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# Functions sent to executors travel by value, so that executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
