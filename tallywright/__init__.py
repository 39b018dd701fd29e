"""Grouped-composition analytics on Spark: shares, peers, inference, text and clusters."""

import sys

from pyspark import cloudpickle

# Executors need not have this package on their path: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
