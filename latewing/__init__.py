"""Late-interaction retrieval as Spark jobs: scoring, registry, ingestion, search."""
