"""Commands: the closed set of what a user can ask for."""
