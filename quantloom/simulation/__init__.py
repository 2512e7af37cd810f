"""Order simulation: a small sequential kernel that Spark runs once a series, in grouped tasks."""
