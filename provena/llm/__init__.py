"""Operators for preparing training corpora. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry this package's code with them, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
