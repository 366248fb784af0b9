"""Operators for training data: tokens, packing, splitting, term counts, top-n and stratified samples."""
