"""workrisk: Spark-native analytics for occupational exposure to automation.

Every public operator is a lazily planned ``DataFrame -> DataFrame`` function
(column names as parameters) that computes all areas in one pass.
"""

__all__ = ["session"]
