"""operators of lumenscribe."""
