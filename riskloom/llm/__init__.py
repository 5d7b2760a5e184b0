"""Training-data operators: ten independent modules over plain DataFrames.

Nothing outside this subpackage imports it.  ``queries.py`` lists the
registered queries; every operator module can be used on its own.
"""
