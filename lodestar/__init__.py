"""Retrieval, RAG evaluation and training-data operators for Spark."""

import sys

from pyspark import cloudpickle

# Executors then need no copy of the package: its functions travel inside the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
