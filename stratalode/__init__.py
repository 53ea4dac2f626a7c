"""stratalode: records, objects, vectors and graphs in one store, on Spark."""
