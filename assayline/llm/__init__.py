"""Operators for building language-model training corpora.

Nothing else in the package imports this one; ``__spark_entry__`` registers its
queries when the folder is present.

Functions of this folder travel to the executors by value, so that a cluster needs no
copy of it there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
