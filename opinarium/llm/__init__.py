"""Operators of a training-data pipeline: quality, toxicity, chat logs, copies, search, tokens, mixing, secrets.

Every operator takes and returns DataFrames and has its own module. Functions that run in
Python workers travel with the job, so the library need not be installed on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
