"""Predicate language: text to syntax tree to Spark columns, plan cache and query statistics."""
