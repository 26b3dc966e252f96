"""Rules and the operators they are made of."""
