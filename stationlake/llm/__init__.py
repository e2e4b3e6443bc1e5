"""Operators of a training-data pipeline. Nothing else in stationlake imports this subpackage."""
