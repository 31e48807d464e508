"""Column functions and the fixed values they use."""
