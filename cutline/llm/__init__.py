"""Operators a training-data pipeline needs, each with a registered query.

Nothing else in the library imports this subpackage. Its functions travel to Python workers by
value, so a cluster needs no installed copy of the package.
"""

from pyspark import cloudpickle

import cutline.llm as _own

cloudpickle.register_pickle_by_value(_own)
