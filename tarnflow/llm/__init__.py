"""Training-data operators: one module each, with a thin contract query beside the operator."""
