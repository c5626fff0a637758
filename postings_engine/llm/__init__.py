"""Operators of a training-data pipeline, and the queries and SQL that exercise them.

Nothing else in the library imports this subpackage.
"""

from ..session import ship_code

# The subpackage's Python functions travel with the tasks; executors need no installed copy.
ship_code(__name__)
