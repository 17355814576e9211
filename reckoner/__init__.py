"""Reckoner: Spark-native reconciliation, accounting, agreement and data-quality operators.

Every operator takes and returns DataFrames; nothing here collects data that grows with the input.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
