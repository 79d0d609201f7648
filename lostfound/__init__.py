"""PySpark jobs that reunite separated people: registries, matching, geography, routes and streams."""
