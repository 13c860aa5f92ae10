"""Multi-operator questions answered in one lazy plan."""
