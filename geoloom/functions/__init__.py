"""Column expressions and Arrow-batch functions shared by the operators."""
