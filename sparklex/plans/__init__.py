"""Plan-level building blocks: shared scratch tables and iterative graph algorithms."""
