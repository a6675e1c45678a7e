"""Join shapes and whole studies composed from the operators."""
