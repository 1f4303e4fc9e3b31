"""Configuration and saved state."""
