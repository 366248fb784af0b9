"""Detection, segmentation and tracking analytics on Spark DataFrames.

Subpackages: ``sources`` (readers, writers), ``functions`` (column expressions), ``operators``
(DataFrame -> DataFrame), ``plans`` (metrics and the query registry), ``streaming`` (stateful tracker)
and ``llm`` (optional operators for training data; nothing else imports it).
"""
