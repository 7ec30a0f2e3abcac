"""Search and indexing of mixed document collections on Spark."""
