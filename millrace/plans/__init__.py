"""SQL front and the registered queries."""
