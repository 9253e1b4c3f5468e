"""lattica: weighted, typed, directed knowledge graphs as Spark DataFrame plans."""
