"""Spark-native analytics for system-provenance captures.

Every operator is a function from DataFrame to DataFrame.  ``functions`` holds column expressions,
``sources`` scans and sinks, ``operators`` the relational work, ``plans`` whole jobs and the registered
queries, ``streaming`` the Structured Streaming counterparts.
"""
