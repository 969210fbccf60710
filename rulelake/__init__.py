"""Rule lineage, layered annotations and call graphs as Spark relations."""
