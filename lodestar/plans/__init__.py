"""Part of lodestar: plans."""
