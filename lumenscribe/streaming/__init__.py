"""streaming of lumenscribe."""
