"""The bound review view and the catalogue of checked queries."""
