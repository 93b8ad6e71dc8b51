"""Structured Streaming: series assembly from event streams, and scoring of fitted models on streams."""
