"""Training and scoring plans made of the operators."""
