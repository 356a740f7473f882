"""A PySpark-native engine for collections of content-addressed records."""
