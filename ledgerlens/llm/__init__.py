"""Operators that prepare training text; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel by value, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
