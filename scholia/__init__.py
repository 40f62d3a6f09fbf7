"""Education analytics and text-corpus processing on Spark."""
