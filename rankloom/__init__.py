"""rankloom: ranking, change-detection and data-preparation operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code: workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
