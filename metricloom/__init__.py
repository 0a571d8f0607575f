"""Spark-native analytics for operational metrics and scaling decisions.

Every public operator is a function ``DataFrame -> DataFrame`` with explicit
parameters.  Nothing here reads the clock: ``now`` is always an argument.
"""
