"""Spark-first analytics for the uncertainty and quality of sampled language-model outputs."""
