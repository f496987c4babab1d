"""Checkpoint logs as streams."""
