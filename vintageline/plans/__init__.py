"""Publication and training flows composed from the operators."""
