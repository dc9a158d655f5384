"""Compliance analytics over filings and rule documents, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so that the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
