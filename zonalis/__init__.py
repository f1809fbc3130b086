"""zonalis: Spark-native calibration analytics over gridded ensembles.

Every array of the workflow is a long table keyed by its axes, and every step is
a plain function from DataFrames to a DataFrame.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in tasks travel with the task: executors need not have the package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
