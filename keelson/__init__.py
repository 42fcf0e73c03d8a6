"""keelson: versioned vector banks, lexical retrieval, lineage, event logs and corpus analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
