"""Jobs that chain the operators, and the registry of queries over the driver's tables."""
