"""A Spark library that turns piles of documents, model outputs and event logs into clean, scored evidence tables."""
