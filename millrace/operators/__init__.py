"""Row, key, join, window and output operators; every one returns a lazy DataFrame."""
