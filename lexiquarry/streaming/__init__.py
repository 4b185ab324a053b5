"""Following a changing tree."""
