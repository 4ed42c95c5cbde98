"""Part of loopwatch."""
