"""Sources and configuration."""
