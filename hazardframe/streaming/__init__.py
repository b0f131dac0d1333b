"""Stream forms of the hourly feeds."""
