"""Part of ledgerloom; see README.md."""
