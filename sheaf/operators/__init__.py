"""DataFrame(s) + parameters -> DataFrame."""
