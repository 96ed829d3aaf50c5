"""tensorloom: sparse tensor analytics planned as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions travel to the executors with their code, so nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
