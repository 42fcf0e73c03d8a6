"""Operators for preparing large text-training corpora.

Nothing outside this folder imports it; ``queries`` registers its operators.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
