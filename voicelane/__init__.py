"""Customer-review analytics as Spark jobs: ingest, enrich, summarise, prepare training data."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value: executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
