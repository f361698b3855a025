"""docmeter: document-quality analytics and reporting on Apache Spark.

The package is registered for pickling by value, so that functions shipped to
executors work on clusters where only the driver has the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
