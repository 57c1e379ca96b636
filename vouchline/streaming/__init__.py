"""streaming of the vouchline engine."""
