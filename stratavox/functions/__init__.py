"""Column functions: integer kernels, text and protocol scalars, digests."""
