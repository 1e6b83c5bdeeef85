"""tidemark: governed batch data work expressed as Spark DataFrame jobs."""
