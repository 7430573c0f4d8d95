"""Sources of the array-sensor library."""
