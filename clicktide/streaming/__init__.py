"""The ad-click pipeline as Structured Streaming queries."""
