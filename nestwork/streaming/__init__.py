"""Continuously maintained documents: state, queues, engine and streams."""
