"""Part of lodestar: operators."""
