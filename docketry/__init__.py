"""docketry: Spark jobs over large collections of case documents.

Sources and sinks live in ``docketry.sources``, column builders in
``docketry.functions``, whole-table jobs in ``docketry.operators``, shared
physical shapes (ordinals, block scoring, size guards) in ``docketry.plans``
and the Structured Streaming twins in ``docketry.streaming``.
"""
