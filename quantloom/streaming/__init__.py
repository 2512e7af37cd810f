"""Structured Streaming: bars from ticks, late data, and strategies on live bars."""
