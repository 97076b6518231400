"""lodestone: composable, lazy DataFrame-in / DataFrame-out analytics operators for Spark."""
