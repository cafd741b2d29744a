"""srcatlas: Spark-native analytics over source-code repositories and other linked corpora."""
