"""strataq.sources package."""
