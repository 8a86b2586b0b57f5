"""Operators for preparing large text collections for the training of language models."""
