"""Part of quillstream."""
