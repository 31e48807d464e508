"""Detection, correlation and report operators (DataFrame in, DataFrame out)."""
