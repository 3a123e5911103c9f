"""Operators for building training corpora.

Nothing outside this package imports it.  Every operator has a module of its
own with a general interface; the thin queries that the driver runs are in
``queries``.
"""
