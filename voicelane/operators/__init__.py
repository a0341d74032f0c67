"""Jobs: each takes and returns ``DataFrame``."""
