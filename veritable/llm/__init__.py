"""Training-data operators: thirteen independent building blocks for corpus preparation.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
