"""lumenscribe: synthetic text-sample generation and corpus processing on Spark.

Everything relational is Column expressions; only pixels and array kernels
run in Python, Arrow batch by Arrow batch.
"""

import sys

from pyspark import cloudpickle

# Kernels travel to executors by value, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
