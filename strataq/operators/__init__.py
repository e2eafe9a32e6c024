"""strataq.operators package."""
