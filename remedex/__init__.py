"""remedex: a Spark-first analytics engine for drug-repurposing research.

Subpackages: ``functions`` (column expressions), ``sources`` (readers and sinks), ``operators`` (DataFrame to
DataFrame), ``plans`` (named queries over the test tables with their SQL) and ``streaming``.  ``llm`` stands alone:
nothing else in the library imports it.
"""
