"""Table readers and the views that feed the operators."""
