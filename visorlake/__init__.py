"""Visual-dataset curation and detection analytics as Spark DataFrame operators."""
