"""Part of stationlake: streaming."""
