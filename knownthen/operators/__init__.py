"""DataFrame operators: bitemporal reads, features, audit, feed and quality checks."""
