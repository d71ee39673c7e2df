"""Operators for preparing training data, and the queries that apply them.

Functions sent to executors travel by value, so a cluster needs only Python,
numpy and pyarrow there, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
