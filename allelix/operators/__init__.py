"""Filters, genotype resolution, statistics, matrices and file formats over DataFrames of variants and genotypes."""
