"""The registered queries, family by family, each with its SQL."""
