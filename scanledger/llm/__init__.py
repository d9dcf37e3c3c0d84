"""Operators for large-scale text and embedding pipelines; nothing outside this folder imports them."""

from pyspark import cloudpickle

import scanledger

# Functions travel to the executors by value: these need no copy of this package.
cloudpickle.register_pickle_by_value(scanledger)
