"""Where relations come from."""
