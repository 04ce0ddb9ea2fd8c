"""The same features on streams."""
