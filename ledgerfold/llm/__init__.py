"""Operators for preparing training corpora at scale.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` registers a thin query per operator.
"""
