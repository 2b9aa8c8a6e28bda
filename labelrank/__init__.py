"""Label the winner of every group, prepare features, train classifiers and rank candidates, on Spark."""

__version__ = "0.1.0"
