"""ml of the engine."""
