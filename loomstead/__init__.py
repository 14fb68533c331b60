"""loomstead: curation and evaluation of instruction data as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
