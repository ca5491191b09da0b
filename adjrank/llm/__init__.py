"""Operators for preparing training text, one module each.

Functions that run in Spark's Python workers are shipped by value, so that the
executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
