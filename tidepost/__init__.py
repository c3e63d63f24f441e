"""Analytics over collections of social posts and saved pages, on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so that executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
