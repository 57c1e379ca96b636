"""operators of the vouchline engine."""
