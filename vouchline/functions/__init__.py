"""functions of the vouchline engine."""
