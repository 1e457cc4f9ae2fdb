"""Column-level building blocks; nothing here shuffles or triggers an action."""
