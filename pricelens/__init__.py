"""pricelens: retail price analytics as lazy Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function built from Catalyst
expressions, grouped aggregates and joins, so it composes with
``DataFrame.transform``. Building a plan runs no job; actions are left to the
caller (training, sinks, level discovery, strict rejection), besides the
checkpoint of range-sorted rows inside ``functions.rank.group_rank``.
"""

from pricelens.session import get_session  # noqa: F401

__all__ = ["get_session"]
