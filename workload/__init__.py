"""The engine's operators bound to the given tables, with the equivalent SQL of each."""
