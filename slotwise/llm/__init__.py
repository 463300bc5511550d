"""Operators of a training-data pipeline over whole text tables.

Functions of this package travel to the workers by value, so a job may be
started from any folder without installing the package on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
