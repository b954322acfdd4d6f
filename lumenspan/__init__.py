"""Analytics over code changes, metadata and lineage, written as Spark plans."""
