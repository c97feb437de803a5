"""Inputs and storage: row sources, versioned tables, intermediate results."""
