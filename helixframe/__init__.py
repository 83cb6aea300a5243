"""A PySpark-native analytics engine for protein-structure collections."""
