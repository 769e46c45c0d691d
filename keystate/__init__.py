"""keystate: keyed, versioned state over an append-only change log, in PySpark."""
