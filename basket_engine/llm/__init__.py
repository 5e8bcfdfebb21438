"""Operators for training-data pipelines over large text corpora.

The worker-side functions of this package travel with the job, so that workers need no
installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
