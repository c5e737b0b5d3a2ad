"""Operators for preparing training data. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Tasks get the functions of these modules themselves and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
