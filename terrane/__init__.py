"""terrane: a Spark-native engine for building, grading and evaluating configuration-code corpora."""
