"""DataFrame operators: samples, statistics, windows, joins, solvers, resampling, decomposition."""
