"""kindred: find and judge confusable records with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions travel to the tasks by value, so that executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
