"""Operators of large-scale training-data pipelines, each a Spark job.

Nothing outside this subpackage imports it.
"""
