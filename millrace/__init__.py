"""Catalog curation on Spark: parse, normalise, classify, resolve, track, validate, search and export."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
