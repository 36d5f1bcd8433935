"""casefile: citation reconciliation and bundle planning over many matters, on Spark."""
