"""echofold: duplicate detection and resolution as composable Spark DataFrame operators."""
