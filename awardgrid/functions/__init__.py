"""Part of the procurement analytics library."""
