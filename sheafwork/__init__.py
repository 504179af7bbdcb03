"""sheafwork: a Spark-native engine for document-to-dataset analytics.

Everything is a ``DataFrame -> DataFrame`` function; Python code that has to run
on executors is shipped by value, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
