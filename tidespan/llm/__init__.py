"""Operators for preparing training corpora, as Spark jobs.

Each module holds one operator; ``queries`` registers them. Nothing outside this
subpackage imports it.
"""
