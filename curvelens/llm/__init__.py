"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from pyspark import cloudpickle

import curvelens

# Functions reach the executors by value, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(curvelens)
