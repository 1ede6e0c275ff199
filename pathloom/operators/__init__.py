"""Graph operators over the entity and relation tables."""
