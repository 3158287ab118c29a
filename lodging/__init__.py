"""Spark-native booking enrichment and revenue analytics.

Layout: ``sources`` (readers, writers, the derived test tables),
``functions`` (classification and revenue rules as Column expressions),
``operators`` (consolidation, lookup joins, enrichment, scalable aggregates),
``plans`` (one function per analysis statement and business question),
``streaming`` (the enrichment export over a stream of booking files).
"""
