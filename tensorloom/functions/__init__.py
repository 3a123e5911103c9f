"""Part of tensorloom."""
