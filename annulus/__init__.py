"""Annulus: keyed-raster analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors run the driver's version of them. The few that are cached (powers of hash bases, the tokenizer)
# are looked up in the package, which executors that run those operators need on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
