"""Pure Python building blocks without Spark; shipped to the workers as modules."""
