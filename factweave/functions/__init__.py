"""Part of factweave; see README.md."""
