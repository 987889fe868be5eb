"""Operators and the pipeline for preparing training text at corpus scale.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when the package is present.
"""
