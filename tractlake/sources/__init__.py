"""Reading and writing tractography files."""
