"""Operators that prepare training text: sharding, filters, duplicates, mixing, packing, token files.

Functions that run in Python workers are sent by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
