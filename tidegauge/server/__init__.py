"""A thin network front end; runs on the driver only."""
