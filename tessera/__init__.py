"""Document-analytics engine on PySpark: declarative DataFrame operators for
chunking, ranking, fusion, de-duplication, storage and evaluation."""
