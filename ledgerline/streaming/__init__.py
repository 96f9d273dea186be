"""Event logs and stateful operators, in batch and as streams."""
