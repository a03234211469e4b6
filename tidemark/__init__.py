"""Analytics over replicated, versioned documents on Spark."""
