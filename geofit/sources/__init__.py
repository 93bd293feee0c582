"""Readers for landed files and the normalisers that turn each source into long facts."""
