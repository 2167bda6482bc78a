"""Spark-native operators for geolocated image datasets."""
