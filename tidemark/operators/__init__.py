"""DataFrame operators over interval, genotype and count tables."""
