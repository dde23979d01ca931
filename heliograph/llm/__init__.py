"""Operators of a pipeline for training text. Nothing outside imports this."""
