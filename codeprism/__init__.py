"""A Spark-native codebase-intelligence engine: source trees as tables, checks as queries."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value: nothing is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
