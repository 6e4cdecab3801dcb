"""Voltlake: document, retrieval and conversation analytics as Spark plans."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors by value, so that no executor needs the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
