"""Sketch analytics and training-data operators on PySpark.

Functions of the package that run in Python workers are pickled by value, so
executors need the third-party libraries but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
