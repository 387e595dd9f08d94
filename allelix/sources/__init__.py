"""Where variants and genotypes come from, and the archives they go to."""
