"""textloom: curation, featurisation and rule-based classification of text corpora on Spark.

Functions of this package that run in Python workers are shipped by value, so a cluster needs
no copy of the package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
