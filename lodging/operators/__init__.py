"""DataFrame -> DataFrame operators: consolidation, lookup joins, enrichment, aggregates."""
