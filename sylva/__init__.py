"""sylva: a PySpark-native analytics engine for tree-structured documents."""
