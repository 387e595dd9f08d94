"""Requests, and the variant and genotype filters that follow from them."""
