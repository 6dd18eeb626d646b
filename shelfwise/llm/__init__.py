"""Operators of a training-data pipeline; nothing outside this package imports it.

Functions that run in tasks travel with the job, so that executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
