"""Conversation analytics on Spark: jobs over chat histories, settings changes and app-status logs."""

import sys

from pyspark import cloudpickle

# Python functions that run in tasks are sent along by value, so executors need no copy of the
# package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
