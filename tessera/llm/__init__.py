"""Operators of a training-data pipeline: quality, fingerprints, secrets,
licences, packing, token counts, joins, repeats, mixing, scoring, resampling,
conversation repair and sharding."""

import sys

from pyspark import cloudpickle

# The functions that run in Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])
