"""Windows over event streams (an extension)."""
