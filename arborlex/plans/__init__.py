"""Ready-made plans over the driver tables."""
