"""Column builders: array arithmetic, trace features, text and time conversions."""
