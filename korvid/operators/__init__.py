"""Operators: data frames in, data frames out."""
