"""Listings analytics on Spark: merging, ranking, scorecards and page analytics over dated event listings."""

import sys

from pyspark import cloudpickle

# the few functions that run inside Python tasks travel with the job, so workers need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
