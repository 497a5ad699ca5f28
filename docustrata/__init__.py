"""Analytics over collections of macro-enabled office documents, as Spark jobs."""
