"""Analytics over environmental monitoring tables on Spark."""
