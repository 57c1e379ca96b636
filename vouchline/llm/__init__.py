"""Training-data operators; nothing else in vouchline imports this subpackage."""
