"""Tables, JSON files and file listings that the operators read."""
