"""Part of stationlake: functions."""
