"""Spark-native preparation and evaluation of retrieval training data.

Sub-packages: ``sources`` (scans, sinks, embedding cache), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame), ``streaming`` (incremental jobs)
and ``plans`` (stage runner, registered queries and their SQL twins).
"""
