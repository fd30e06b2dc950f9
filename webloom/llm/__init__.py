"""Operators for preparing large training corpora.

Nothing outside this package imports it.  Every operator takes DataFrames and
column names, and returns a lazily planned DataFrame unless its docstring says
that it materialises an intermediate table (always below ``spark.checkpoint.dir``).
"""
