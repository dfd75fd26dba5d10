"""Cost/quality routing analytics as Spark DataFrame operators.

A request can be served by a cheap ("weak") or an expensive ("strong") model.
The package prepares question tables, grades logged replies, scores how much a
question needs the strong model and measures accuracy against cost.
"""

import sys

from pyspark import cloudpickle

# Functions run inside tasks travel with their code, so that executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
