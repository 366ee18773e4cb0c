"""Operators for preparing language-model training text. Nothing else in the library imports this subpackage.

Functions run inside tasks are shipped by value, so executors need Python, numpy and pyarrow but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
