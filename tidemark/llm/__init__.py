"""Operators of a training-data pipeline over ``documents``, ``benchmark`` and ``labels``.

Functions of this subpackage that run in Python workers are pickled by value, so that executors
need no copy of the library on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
