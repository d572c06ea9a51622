"""Nothing to build here: the evidence this package works on is finished files.

Every function in :mod:`evimill.functions` is a row-wise ``Column`` expression and
so can be applied to a streaming DataFrame as it is.
"""
