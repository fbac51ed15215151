"""Training-data operators: ten stages of a large text pipeline, each on plain DataFrames.

Nothing outside this subpackage imports it.  Row conventions shared by all operators: a null text
counts as an empty one, repeated rows are kept unless an operator says otherwise, and an output
column replaces an input column of the same name.
"""
