"""Trade-tape surveillance for binary-outcome prediction markets, on Spark."""
