"""Deterministic search, measurement and evidence pipelines as PySpark DataFrames."""

import sys

from pyspark import cloudpickle as _pickle

# Executors need no copy of the package: its functions travel with the tasks.
_pickle.register_pickle_by_value(sys.modules[__name__])
