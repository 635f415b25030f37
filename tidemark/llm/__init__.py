"""Operators for preparing training text at scale.

Nothing outside this package imports it.  Every operator first selects the
columns it needs under names of its own, so other columns of the input, whatever
they are called, neither clash nor travel through a shuffle.
"""
