"""strataq.plans package."""
