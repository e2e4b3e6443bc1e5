"""Part of stationlake: plans."""
