"""Pairs-research analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Ship the few Arrow functions by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
