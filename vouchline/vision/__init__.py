"""Optional raster kernels in numpy and the interface for model plug-ins."""
