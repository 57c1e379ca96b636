"""plans of the vouchline engine."""
