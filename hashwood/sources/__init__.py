"""Page stores and the tables they are kept in."""
