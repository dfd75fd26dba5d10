"""Registered queries over the given tables, each with the SQL that must agree with it."""

import sys

from pyspark import cloudpickle

# The stand-ins for models travel to the workers with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
