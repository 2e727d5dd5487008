"""See the README for what is where."""
