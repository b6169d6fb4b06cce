"""A Spark-first engine for gridded and geospatial data.

Functions that run on executors are shipped by value, so a cluster needs no installed copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
