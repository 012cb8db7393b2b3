"""Training-data engine on Spark: API-aware dataset building as DataFrame operators."""
