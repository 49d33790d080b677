"""Episode, ledger and review analytics expressed as Spark plans.

Functions of this package that run in Python workers travel by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def register(spark) -> None:
    """Make the package's named functions and table functions known to the SQL of a session."""
    from episodica.functions.named import register as known

    known(spark)
