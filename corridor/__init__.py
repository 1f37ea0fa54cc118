"""corridor: road-traffic analytics on Spark DataFrames.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, so the same code serves batch jobs and Structured Streaming.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel with their code, so executors
# need not have this package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
