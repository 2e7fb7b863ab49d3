"""A PySpark-native relational analytics engine."""
