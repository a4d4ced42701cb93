"""A PySpark engine that aligns two document collections, with operators for
training data in :mod:`alidade.llm`."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry the library with them, so that a cluster
# needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
