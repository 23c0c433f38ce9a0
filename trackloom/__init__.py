"""Spark jobs for multi-camera motion tracks."""
