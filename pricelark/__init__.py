"""Price-intelligence analytics on Spark: capture, merge, history and dashboards."""
