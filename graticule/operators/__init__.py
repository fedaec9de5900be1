"""DataFrame operators: preparation, sampling, scans, reductions, split search."""
