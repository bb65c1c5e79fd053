"""Reports and jobs composed from the operators."""
