"""Operators for preparing training corpora: each in its own module, with thin queries in ``llm.queries``."""
