"""lumentrace: stimulus-aligned imaging analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few batch helpers that run in Python travel to the executors by value, so the
# package does not have to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
