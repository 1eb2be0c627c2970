"""Event logic over batches and streams."""
