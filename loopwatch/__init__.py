"""loopwatch: DataFrame-first analytics for industrial sensor series."""
