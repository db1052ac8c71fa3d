"""Plans: the engine's queries over tables."""
