"""Jobs composed from operators and sources, and the registered queries."""
