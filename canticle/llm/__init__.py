"""Training-data operators: dedup, decontamination, scoring, mixing, sharding and search on Spark."""
