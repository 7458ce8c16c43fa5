"""A DataFrame engine that reviews technical documents for long-horizon time risks."""
