"""Training-data operators: corpus clean-up, search, mixing and packing.

Nothing else in the library imports this package.
"""
