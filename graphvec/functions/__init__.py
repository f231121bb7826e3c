"""Values and similarity functions."""
