"""Local surrogate explanations for whole tables of instances, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Arrow tasks travel with the plan, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
