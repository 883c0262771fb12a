"""Operators for preparing training text. Nothing else in the library imports this subpackage.

Functions that run in Python tasks are pickled by value, so executors need only the public
libraries, not a copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
