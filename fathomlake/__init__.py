"""Search and versioned storage of JSON resources on Spark: a query language compiled to DataFrame plans."""
