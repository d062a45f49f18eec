"""Operators for training-data pipelines over a corpus of documents.

Nothing else in the library imports this subpackage.  Each operator is a
function over DataFrames in a module of its own; ``catalog`` registers one query
per operator with its SQL where SQL can express it.

Functions that run in Python workers are shipped by value, so executors need the
libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
