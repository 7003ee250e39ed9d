"""Operators of a training-data pipeline: extraction, formatting, sharding, filters, duplicates, packing and scoring."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors with their code, so these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
