"""Operators of the array-sensor library."""
