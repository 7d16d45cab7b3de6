"""Column functions: typed projections and the account classification."""
