"""A Spark-native analytics engine for news articles and geolocated hazard readings."""
