"""Part of lodestar: sources."""
