"""Column functions: pure expressions, evaluated by Spark inside the scan stage."""
