"""Column functions: text in ``text``, vectors in ``vectors``."""
