"""Where identifiers are taken, and datasets."""
