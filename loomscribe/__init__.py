"""loomscribe: corpus analytics and text-provenance measurement on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need no copy of the package: functions that run in tasks travel with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
