"""Domain events and schedules, in batch and as Structured Streaming."""
