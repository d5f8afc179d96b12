"""The registered queries and, next to them, their SQL oracles."""
