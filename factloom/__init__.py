"""factloom: a PySpark-native engine for typed, versioned facts and the graph between them."""
