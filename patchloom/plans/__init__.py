"""Query plans on the supplied tables."""
