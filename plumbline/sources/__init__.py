"""Readers and writers: answer sets, label caches, gold references of the known data sets, published subsets."""
