"""Field dictionary, action schemas and rules."""
