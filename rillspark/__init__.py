"""Spark-native analytics for hydrological and climate series, fields and ensembles."""
