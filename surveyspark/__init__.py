"""Infrared-survey analytics expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Ship the small Python helpers with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
