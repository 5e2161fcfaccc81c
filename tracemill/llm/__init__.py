"""Operators for large text corpora.

Nothing outside this subpackage imports it.  Its worker functions are pickled by value, so executors need no
installed copy of the repository.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
