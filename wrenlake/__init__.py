"""Analytics over segmented recordings and their embedding vectors, as Spark DataFrame plans."""
