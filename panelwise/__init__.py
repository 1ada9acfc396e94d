"""Point-in-time signal, portfolio and monitoring analytics over long price panels, on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

CASH = "$CASH$"

# The few Python functions that run in tasks travel inside the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
