"""Retail basket analytics on Spark: cleaning, segments, rules, factors, recommendations, search."""
