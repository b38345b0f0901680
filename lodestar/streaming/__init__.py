"""Part of lodestar: streaming."""
