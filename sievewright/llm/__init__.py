"""Training-data operators: each is one module; queries.py registers what they answer."""
