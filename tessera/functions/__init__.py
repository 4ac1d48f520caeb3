"""Part of tessera; see the README for the map of modules."""
