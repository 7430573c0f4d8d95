"""Plans of the array-sensor library."""
