"""Sagebrook: a Spark-first engine for retrieval analytics.

Every operator takes and returns DataFrames.  Plans stay lazy and declarative;
Python runs only in Arrow batches, where no built-in expression has the semantics.
"""

__version__ = "0.1.0"
