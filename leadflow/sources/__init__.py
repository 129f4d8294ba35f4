"""Files in and out: header CSV, pasted text, provider tables, CSV sink."""
