"""Spark-native curation of evaluation items and scoring of model runs.

Every operator takes and returns DataFrames and stays lazy unless its docstring says
that it materialises an intermediate table.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so that executors need no
# installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
