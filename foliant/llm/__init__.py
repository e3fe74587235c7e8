"""Operators for preparing language-model training data at corpus scale.

Nothing else in the library imports this subpackage.  Functions that run in Python
workers are shipped by value, so that executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
