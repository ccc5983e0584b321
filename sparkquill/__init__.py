"""sparkquill: retrieval and document analytics expressed as Spark DataFrame operators."""
