"""Plan shapes that several operators share: wide-to-long, global order, quantiles, moments, top-k."""
