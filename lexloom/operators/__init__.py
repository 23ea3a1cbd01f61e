"""DataFrame-to-DataFrame operators: retrieval, intervals, evidence, metrics, storage."""
