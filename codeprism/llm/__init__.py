"""Operators for large-scale training-data pipelines.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its
queries when it is present.
"""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the workers by value: no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
