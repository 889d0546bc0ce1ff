"""arborwell: gradient-boosted trees and their building blocks as plain DataFrame operations."""

import sys

from pyspark import cloudpickle

# Functions go to executors with their code, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
