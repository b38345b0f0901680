"""Part of lodestar: functions."""
