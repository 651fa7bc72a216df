"""Scalar expressions, and the few UDFs that built-in functions can't replace."""
