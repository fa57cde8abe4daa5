"""Operators for preparing training corpora: one module per operator.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its
queries when it is present.
"""
