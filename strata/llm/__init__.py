"""Training-data operators at corpus scale.

Operators, each in a module of its own, plus the queries that apply them
to whole tables (``queries.py``).  Nothing outside this subpackage imports it.

Functions that run inside tasks are pickled by value, so executors need only
numpy, pyarrow and the named tokenizer library, not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
