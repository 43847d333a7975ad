"""A PySpark-native engine that finds sensitive data in mixed collections of files and ranks them by risk."""
