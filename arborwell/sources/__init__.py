"""Reading and writing: sparse text, wide tables, models, predictions."""
