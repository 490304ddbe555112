"""Energy analytics on Spark: solar, consumption and tariff forecasts for many sites, joined into decisions."""
