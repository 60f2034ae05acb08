"""Reading frames as they arrive."""
