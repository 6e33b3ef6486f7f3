"""Training-data operators over the text tables; nothing else in tickvault imports this package."""
