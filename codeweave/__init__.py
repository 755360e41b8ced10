"""codeweave: document/conversation coding with weak or direct supervision,
expressed as long-form PySpark DataFrame operators."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in executors' Python workers travel with the job, so executors need
# not have this package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
