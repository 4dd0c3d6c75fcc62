"""gatherlens: event-hosting analytics on Spark DataFrames.

Sub-packages: ``sources`` (entity scans, lookups, sinks, stand-ins),
``functions`` (Column expressions), ``operators`` (DataFrame -> DataFrame
operators), ``plans`` (registered queries and their SQL oracle), ``streaming``
(incremental occurrence counts).
"""
__version__ = "0.1.0"
