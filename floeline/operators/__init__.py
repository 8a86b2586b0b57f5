"""DataFrame operators: cleaning, reports, ordered windows, quantiles, rollups."""
