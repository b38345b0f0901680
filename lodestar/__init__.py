"""Lodestar: document and procurement analytics written for Spark's DataFrame and SQL engine."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors by value, so that a
# worker needs no copy of the repository on its own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
