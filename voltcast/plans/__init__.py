"""Composed pipelines: features, forecasters, tuning, analytics and sinks."""
