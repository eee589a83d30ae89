"""Training-data operators: ten corpus operators that build on Spark and on nothing else in this library."""
