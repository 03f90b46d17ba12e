"""Evaluate generated markup and images at scale with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions run in Python workers travel with the job, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
