"""confab: a Spark-first analytics engine for recorded and live conversations."""
