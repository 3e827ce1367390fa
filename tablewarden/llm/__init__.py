"""Operators of a training-data pipeline. Nothing outside this subpackage imports it.

Functions that run in tasks travel with the job, so executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
