"""Training-data operators: one module per operator, queries in ``llm.queries``.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
