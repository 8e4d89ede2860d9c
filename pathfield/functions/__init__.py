"""Part of pathfield."""
