"""Linked projections over large event, location and embedding tables, as plain DataFrame plans."""
