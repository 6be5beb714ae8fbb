"""Training-data operators over the tables documents, labels, benchmark and conversations."""
