"""Batch stages for text encoding, pair scoring and token labelling.

Each stage is an object with ``transform(df) -> df``.  The native ones are
column expressions; the ``Plugged*`` ones run a model of the user's in Arrow
batches, loading it once per task.
"""
