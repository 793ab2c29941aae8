"""Spark-native assessment and augmentation of labelled test sets."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the workers by value, so executors need
# numpy, pandas and pyarrow but no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
