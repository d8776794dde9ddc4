"""Column expressions over points."""
