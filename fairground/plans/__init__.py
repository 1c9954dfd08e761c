"""Query plans over the driver's tables."""
