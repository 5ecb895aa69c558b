"""tripwire — two-stage anomaly screening on Spark.

Functions of this package used inside Python UDFs / ``mapInPandas`` /
``applyInPandas`` are pickled by value, so executors need no copy of the
package on their path.
"""

import sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
