"""Stream forms of the stateless jobs."""
