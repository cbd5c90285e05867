"""snapforge."""
