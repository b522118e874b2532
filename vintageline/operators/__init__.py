"""DataFrame-to-DataFrame operators: typing, gates, survival framing, as-of joins, splits, summaries."""
