"""leadflow: company and contact data flows as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# the few Python helpers travel with their job, so executors need no installation
cloudpickle.register_pickle_by_value(sys.modules[__name__])
