"""Analytics over code-and-document knowledge graphs, as Spark jobs."""
