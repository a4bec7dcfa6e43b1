"""Expression builders, all of built-in Spark expressions.

``text`` and ``chat`` take SQL text and give SQL text, for ``F.expr`` and
``where``: the import expression has hundreds of nodes, and as one text it costs
one call into the JVM. ``ratios`` takes and gives columns.
"""
