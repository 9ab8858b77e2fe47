"""Column functions shared by the query languages."""
