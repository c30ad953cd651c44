"""Name rules (driver metadata) and column expressions (JVM side)."""
