"""The full analysis, composed from the operators."""
