"""Operators for large text corpora.  Nothing else in the library imports this subpackage."""

from pyspark import cloudpickle as _pickle

import lodestone as _top

# Executors need no copy of the package: its functions travel with the tasks.
_pickle.register_pickle_by_value(_top)
