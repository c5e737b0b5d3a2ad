"""Whole jobs made of operators: corpus, search, store, change sets, output."""
