"""DataFrame -> DataFrame operators, all products at once."""
