"""Session settings and how the package reaches the executors."""
