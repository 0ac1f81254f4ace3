"""Lossless, verifiable processing of image volumes and object collections on Spark."""
