"""Part of stationlake: sources."""
