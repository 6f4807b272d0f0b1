"""DataFrame operators for exploring large collections of experiment runs."""

import sys

from pyspark import cloudpickle

# Python tasks carry the code they run, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
