"""Building blocks of the engine."""
