"""Query plans: the composed queries of the engine."""
