"""Ways to run kernels over DataFrames, and sinks."""
