"""Part of skyloom; see README.md."""
