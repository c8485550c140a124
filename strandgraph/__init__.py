"""Property-graph schema discovery and schema scoring on Spark.

Functions that run in Python workers are pickled by value, so executors need
pandas, numpy and pyarrow but not an installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
