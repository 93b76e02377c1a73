"""Readers of state and results, and the sinks that write them."""
