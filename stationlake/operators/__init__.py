"""Part of stationlake: operators."""
