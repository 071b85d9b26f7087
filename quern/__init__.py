"""A PySpark-native analytics library: relational operators, sources, functions, plans, streaming, and training-data operators."""
