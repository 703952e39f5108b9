"""Jobs to run from a command line; each does its work in a function that takes a session."""
