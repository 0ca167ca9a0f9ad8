"""seqlattice: sequence-alignment analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value, which then need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
