"""plans of lumenscribe."""
