"""Rule packs: all domain knowledge, kept as plain data."""
