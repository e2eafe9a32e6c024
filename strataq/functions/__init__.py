"""strataq.functions package."""
