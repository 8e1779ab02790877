"""Plumbline: outcome analytics over change ledgers, snapshots, nested records and texts, on Spark.

The package is a library of DataFrame -> DataFrame operators (``operators``), column
expressions (``functions``), readers and writers (``sources``), registered queries
(``plans``) and streaming variants (``streaming``).  The optional subpackage ``llm`` holds
operators for training corpora; nothing outside it imports it.
"""

__version__ = "0.1.0"
