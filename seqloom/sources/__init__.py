"""Tables and token streams."""
