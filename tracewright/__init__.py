"""Rule-based text operators and training-data pipelines on Spark."""
