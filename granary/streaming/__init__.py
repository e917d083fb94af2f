"""Structured Streaming jobs and the batch forms of queue and rate-limit steps."""
