"""Business-contact analytics as Spark DataFrame operators."""
