"""Streaming of the array-sensor library."""
