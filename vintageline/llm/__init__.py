"""Operators for building training corpora. Nothing else in the library imports this subpackage.

Functions of the subpackage travel to the executors by value, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
