"""sources of the vouchline engine."""
