"""Tables as objects, and trees of files."""
