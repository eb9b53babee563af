"""Errors of the graph operators; wrong kinds of arguments raise TypeError, wrong values ValueError or KeyError."""


class ConvergenceError(Exception):
    """An iteration reached its round limit before its tolerance."""
