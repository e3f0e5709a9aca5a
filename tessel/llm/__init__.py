"""Operators for training-data pipelines over ``documents``, ``pages`` and ``embeddings``.

Nothing outside this subpackage imports it.
"""
