"""Menu pages and menu text to ranked, explained meals, as Spark DataFrame transformations."""
