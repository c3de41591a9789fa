"""Training-data operators over text corpora; nothing outside this package imports it."""
