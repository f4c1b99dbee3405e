"""Volume analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors with the task, so that they need no copy of this package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
