"""Operators for preparing training data; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Tasks get the code of these operators with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
