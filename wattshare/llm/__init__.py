"""Preparing training text at scale: duplicates, private data, secrets, toxicity, mixing and packing.

Every operator takes a table of documents (or vectors) with an id, reads only the columns it names and returns a table
of its own columns, so further columns of any name do no harm.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the tasks: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
