"""Operators for training-data pipelines: mergeable percentiles, top rows per group, tokenizer encoding, test-item leaks, subjects."""
