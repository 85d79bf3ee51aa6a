"""Analytics over raster collections and their metadata, as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
