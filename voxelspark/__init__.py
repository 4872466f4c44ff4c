"""voxelspark: volumes, graphs and lookup tables as DataFrames, with Catalyst doing the planning."""
