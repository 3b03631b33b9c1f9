"""Training-data operators: ten corpus-scale building blocks and their registered queries."""
