"""Sources: files, Kafka and JDBC options, and synthetic data."""
