"""Selection operators: given a pool and a budget, which rows to take."""
