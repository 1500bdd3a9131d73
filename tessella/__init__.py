"""tessella: a PySpark-native engine for tables and time series.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers and writers), ``plans`` (registered queries
and their oracle SQL), ``streaming`` and, optional, ``llm``.
"""
