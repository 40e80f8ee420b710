"""Operators for large training-data pipelines (one module per operator)."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job: a cluster needs no
# installed copy of this package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
