"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own general interface; ``queries`` derives the digest columns of the thin
``opN_*`` queries from those interfaces.
"""
