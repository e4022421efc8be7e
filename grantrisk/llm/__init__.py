"""Operations of a training-data pipeline over the tables ``documents``,
``embeddings``, ``pages`` and ``labels``.

Nothing else in the library imports this subpackage.  Functions that run in
Python workers are pickled by value, so executors need no copy of it.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
