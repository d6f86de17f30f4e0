"""gridwell: sparse-matrix and corpus analytics expressed as Spark DataFrame plans."""
