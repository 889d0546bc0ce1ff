"""Column functions: losses, metrics, gains."""
