"""Part of verspan."""
