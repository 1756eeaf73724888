"""Operators on corpora of text for training language models; nothing outside this folder imports it."""
