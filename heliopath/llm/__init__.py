"""Operators of a training-data pipeline over document tables.

Nothing else in the library imports this package. Every operator takes a
DataFrame, names the columns it reads and selects only those, so further
columns of any name are left alone.
"""
