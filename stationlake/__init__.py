"""stationlake: Spark jobs for station-based fleets and for training-data corpora."""
