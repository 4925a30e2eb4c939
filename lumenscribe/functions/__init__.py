"""functions of lumenscribe."""
