"""sources of lumenscribe."""
