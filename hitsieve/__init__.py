"""Labelled binary screening analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions shipped to executors travel by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
