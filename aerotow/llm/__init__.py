"""Training-data operators: thirteen corpus operators on Spark, their registered queries and SQL twins.

Nothing else in the package imports this subpackage; ``__spark_entry__.py`` adds its queries when it is there.
Task functions of this subpackage are sent to the workers by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
