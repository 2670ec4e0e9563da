"""Training-data operators: ten stages over whole document tables.

Nothing outside this subpackage imports it.  ``queries`` registers one query per operator.
"""
