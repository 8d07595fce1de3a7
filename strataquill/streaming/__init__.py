"""Event logs: batch folds and the same as streams."""
