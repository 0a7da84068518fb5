"""Structured Streaming forms of counts, sessions and the trigger."""
