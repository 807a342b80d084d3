"""Operators for training-data corpora. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Workers get the functions themselves, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
