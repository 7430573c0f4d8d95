"""Functions of the array-sensor library."""
