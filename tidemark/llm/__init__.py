"""Operators for training data: near-duplicates, survivors, token ids, packing, residue. Nothing outside imports this."""
