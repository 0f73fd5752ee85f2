"""Operators of a training-data pipeline over documents and web pages.

Nothing outside this subpackage imports it.  Functions that run in Python
workers are shipped by value, so executors need Spark and the public
libraries only, not a copy of this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
