"""Particle and galaxy-model analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors with the job, so that
# the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
