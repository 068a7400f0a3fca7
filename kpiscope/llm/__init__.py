"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it, so it can be removed as a whole.
Each module holds one operator with a general interface; ``queries`` holds the thin
``opN_*`` queries with production parameters, and their SQL where SQL can express them.
"""
