"""Operators that a training-data pipeline needs; nothing else in the library imports this subpackage.

The subpackage is pickled by value, so that executors need no copy of the
library on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
