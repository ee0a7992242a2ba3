"""Training-data operators (one module each) and their registered queries.

Task functions are shipped to the executors by value, so that a cluster needs
numpy, pyarrow and pandas but not this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
