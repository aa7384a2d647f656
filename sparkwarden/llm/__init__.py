"""Training-data operators: one module per operator, each with a general function and one thin query."""
