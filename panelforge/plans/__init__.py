"""Jobs: parameters, cache keys, and the operators each kind of job runs."""
