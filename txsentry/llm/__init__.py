"""Operators of a training-data pipeline (dedup, sharding, mixing, tokens, ...).

Nothing outside this subpackage imports it; ``__spark_entry__.py`` registers
its queries when it is present.
"""
