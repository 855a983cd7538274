"""Structured Streaming forms of append-only inputs."""
