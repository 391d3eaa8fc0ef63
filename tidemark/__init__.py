"""Market-signal analytics as DataFrame-to-DataFrame transformations on Spark."""
