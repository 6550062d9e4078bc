"""crashmart: batch analytics over event records published in different native schemas, as plain Spark plans."""
