"""The six tools as compositions of operators; phases are written to the shared folder by default."""
