"""The stateless jobs as Structured Streaming queries."""
