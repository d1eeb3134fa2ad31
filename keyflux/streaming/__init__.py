"""Live operation logs."""
