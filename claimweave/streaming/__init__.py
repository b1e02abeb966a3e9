"""Documents that arrive while a graph stands."""
