"""Operators for preparing large-scale training data.

One module per operator; ``queries`` registers one thin query per operator
over the given tables. Nothing outside this subpackage imports it, except the
guarded lines of the driver's entry file.
"""
