"""lodestone: retrieval, ranking and analytics over DataFrames of points, texts and graphs."""
