"""agora: a PySpark-native engine for finding, scoring and studying discussion regions in web pages."""
