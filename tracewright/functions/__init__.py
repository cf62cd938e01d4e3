"""Column functions over traces, answers and rewards."""
