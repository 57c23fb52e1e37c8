"""Column functions: names, genotypes, variant typing, CpG scans and scores."""
