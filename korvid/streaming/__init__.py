"""Streams of results and of files, cancellation and timeouts."""
