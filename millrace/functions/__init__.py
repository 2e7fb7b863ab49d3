"""Column expressions of the engine's dialect."""
